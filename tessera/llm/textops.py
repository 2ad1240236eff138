"""Vectorised word and hash kernels shared by the Python-side operators.

A batch of texts becomes one byte buffer with all words separated by single
spaces plus the word boundaries; hashes are then computed with numpy over the
whole batch, so the cost a word is a few dozen machine operations instead of
several Python objects.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

#: Words are maximal runs of bytes other than these (ASCII white space), which
#: is exactly how bytes.split() splits.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

# The five primes of the XXH64 specification.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)

#: Spans at least this long are hashed one by one by the xxhash library.
LONG_SPAN = 256
_PAD = 8


@dataclass
class Words:
    """Words of a batch: ``buffer`` (uint8, padded), word ``starts``/``ends``
    and ``first`` (the word index at which each text starts, plus the total)."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> int:
        return len(self.starts)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def batches(texts: Iterable[bytes], most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a list of texts into runs of about ``most`` bytes: (first index, run)."""
    run: list[bytes] = []
    size = begin = 0
    for i, text in enumerate(texts):
        run.append(text)
        size += len(text)
        if size >= most:
            yield begin, run
            run, size, begin = [], 0, i + 1
    if run:
        yield begin, run


def to_words(texts: list[bytes], lower: bool = False) -> Words:
    """Words of each text; with ``lower`` A-Z become a-z first."""
    split = [(t.translate(LOWER) if lower else t).split() for t in texts]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, split), np.int64, len(split)), out=first[1:])
    joined = b" ".join([b" ".join(words) for words in split if words]) + b" "
    if first[-1] == 0:
        return Words(np.zeros(_PAD, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), first)
    buffer = np.frombuffer(joined + b"\0" * _PAD, np.uint8)
    ends = np.flatnonzero(buffer[: len(joined)] == 32)
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    return Words(buffer, starts, ends, first)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * P2, 31) * P1


def _hash_equal_lengths(lanes: np.ndarray, buffer: np.ndarray, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
    """XXH64 of spans that all have ``length`` bytes."""
    at, rest = starts, length
    seed64 = np.uint64(seed)
    if length >= 32:
        begin = (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)
        acc = [np.full(len(starts), v, np.uint64) for v in begin]
        while rest >= 32:
            for k in range(4):
                acc[k] = _round(acc[k], lanes[at + 8 * k])
            at, rest = at + 32, rest - 32
        h = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
        for v in acc:
            h = (h ^ _round(np.zeros_like(v), v)) * P1 + P4
    else:
        h = np.full(len(starts), seed64 + P5, np.uint64)
    h = h + np.uint64(length)
    while rest >= 8:
        h = _rotate(h ^ _round(np.zeros_like(h), lanes[at]), 27) * P1 + P4
        at, rest = at + 8, rest - 8
    if rest >= 4:
        h = _rotate(h ^ ((lanes[at] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at, rest = at + 4, rest - 4
    while rest:
        h = _rotate(h ^ (buffer[at].astype(np.uint64) * P5), 11) * P1
        at, rest = at + 1, rest - 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    return h ^ (h >> np.uint64(32))


def xxh64_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of every span ``buffer[start:end]``; the buffer needs 8 spare bytes."""
    out = np.empty(len(starts), np.uint64)
    lanes = np.ndarray(len(buffer) - 7, "<u8", buffer, 0, (1,))  # the eight bytes from each offset
    with np.errstate(over="ignore"):
        for lo in range(0, len(starts), 1 << 18):
            part = slice(lo, lo + (1 << 18))
            first, length = starts[part], np.minimum(ends[part] - starts[part], LONG_SPAN).astype(np.uint16)
            order = np.argsort(length, kind="stable")
            sizes, begins = np.unique(length[order], return_index=True)
            target = np.empty(len(order), np.uint64)
            for k, size in enumerate(sizes):
                members = order[begins[k] : begins[k + 1] if k + 1 < len(sizes) else None]
                if size < LONG_SPAN:
                    target[members] = _hash_equal_lengths(lanes, buffer, first[members], int(size), seed)
                else:
                    for m in members:
                        target[m] = xxhash.xxh64_intdigest(buffer[starts[lo + m] : ends[lo + m]].tobytes(), seed)
            out[part] = target
    return out


def bit_majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run ``hashes[first[i]:first[i+1]]`` the 64-bit word whose bits
    are those set in over half of the run; zero for an empty run.

    Eight byte-wide counters share one 64-bit lane, so runs are summed in
    pieces of at most 255 hashes before the counters are widened.
    """
    out = np.zeros(len(first) - 1, np.uint64)
    sizes = np.diff(first)
    full = np.flatnonzero(sizes > 0)
    if not len(full):
        return out
    pieces = -(-sizes[full] // 255)
    run_of = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(run_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[full][run_of] + 255 * nth
    run_begin = np.cumsum(pieces) - pieces
    ones = np.uint64(0x0101010101010101)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & ones, begin)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run_begin, axis=0)
        major = 2 * counts > sizes[full][:, None]
        for byte in range(8):
            out[full] |= major[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def as_bytes(column) -> list[bytes]:
    """Arrow string column to UTF-8 bytes; null counts as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


class Texts:
    """Texts of an Arrow string column as UTF-8 bytes, a few at a time, so that a
    batch of long texts is not held twice; null counts as empty."""

    ROWS = 256

    def __init__(self, column):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __iter__(self) -> Iterator[bytes]:
        for lo in range(0, len(self.column), self.ROWS):
            yield from as_bytes(self.column.slice(lo, self.ROWS))
