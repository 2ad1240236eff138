"""Substring dedup over fixed-length word windows.

Every window of ``window`` consecutive words gets a Rabin-Karp hash; a window
that also starts in a document with a smaller id is repeated, the words of
repeated windows are removed, and overlapping windows merge into maximal
intervals.

How the counting scales.  One row a window would shuffle several times the
corpus, so windows travel packed.  Documents are dealt into *chunks* that are
ranges of ids, hence "an earlier chunk has it" is "a smaller id has it", and no
id needs to travel at all.  A chunk sends its distinct hashes, sorted and
delta-coded, to hash-range *buckets*; however often a passage occurs, a chunk
sends it once, so no bucket grows with the copies of a passage.  A bucket
answers each chunk with one bit a hash: seen in an earlier chunk or not.  The
chunk then marks its windows.  About eight bytes a window travel once, one bit
travels back, and a task holds one chunk or one bucket, both of bounded size.

Windows are compared by 80 bits: a 64-bit hash and 16 bits of a second,
independent one.  Among n distinct windows the chance that one is wrongly taken
for another is about n / 2**80 a window, 1e-11 at 10**13 windows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textops
from tessera.llm.common import chunk_size, shuffle_partitions, text_bytes

#: Odd multipliers of the two rolling hashes, and the seed of the word hash.
BASE = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xD1B54A32D192ED03)
WORD_SEED = 1
LAST_ID = 2**63 - 1
#: Sampled rows a chunk, and in all, at least; a chunk number is that of its range, shifted, and a part.
SAMPLE, SAMPLED, PARTS_SHIFT = 256, 1 << 20, 20

RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"
#: Prefix of carried columns inside the operator, so that they can't clash.
_CARRIED = "__carried_"


def rolling_hashes(words: np.ndarray, window: int, base: np.uint64) -> np.ndarray:
    """Rabin-Karp hash, sum of words[i+j] * base**(window-1-j) mod 2**64, of the
    window at each i; built by doubling, H[a+b](i) = H[a](i) * base**b + H[b](i+a)."""
    with np.errstate(over="ignore"):
        done, have = None, 0
        block, size, power = words, 1, base
        left = window
        while left:
            if left & 1:
                if done is None:
                    done, have = block, size
                else:
                    n = len(words) - have - size + 1
                    done = done[:n] * power + block[have : have + n] if n > 0 else done[:0]
                    have += size
            left >>= 1
            if left:
                n = max(0, len(block) - size)
                block = block[:n] * power + block[size : size + n]
                size, power = 2 * size, power * power
    return done if len(words) >= window else done[:0]


@dataclass
class _Windows:
    """The windows of one chunk in id order."""

    runs: list  # (first text, Words, mask of words that start a window)
    hashes: np.ndarray
    second: np.ndarray
    text: np.ndarray


def _windows(texts: list[bytes], window: int) -> _Windows:
    runs, hashes, second, text = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.int32)]
    for begin, run in textops.batches(texts):
        words = textops.to_words(run)
        of = words.text_of_word()
        n = max(0, words.count - window + 1)
        valid = of[:n] == of[words.count - n :] if n else np.zeros(0, bool)
        word_hashes = textops.xxh64_spans(words.buffer, words.starts, words.ends, WORD_SEED)
        hashes.append(rolling_hashes(word_hashes, window, BASE)[valid])
        second.append((rolling_hashes(word_hashes, window, SECOND)[valid] >> np.uint64(48)).astype(np.uint16))
        text.append((of[:n][valid] + begin).astype(np.int32))
        runs.append((begin, words, np.flatnonzero(valid)))
    return _Windows(runs, np.concatenate(hashes), np.concatenate(second), np.concatenate(text))


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Hash ranges: rises with the hash, so a bucket is a slice of sorted hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def pack_sorted(hashes: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte plane by byte plane; the upper
    planes are zero and vanish in the shuffle's compression."""
    delta = np.diff(hashes, prepend=np.uint64(0))
    return delta.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(blob: bytes | memoryview, n: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8, 8 * n).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _in_id_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(rank of each row's id, positions in the input, texts), sorted by id; equal ids share a rank."""
    ids = table.column("order_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    _, rank = np.unique(ids[order], return_inverse=True)
    texts = textops.as_bytes(table.column("text").combine_chunks())
    return rank.astype(np.int32), order, [texts[i] for i in order]


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts, where each run of equals begins in that order)."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(new)


def _send(window: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        _, _, texts = _in_id_order(table)
        found = _windows(texts, window)
        order, begins = _distinct(found.hashes)
        hashes, second = found.hashes[order[begins]], found.second[order[begins]]
        bucket = _bucket_of(hashes, buckets)
        cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(2**63))) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(bucket))
        return pa.table(
            {
                "bucket": pa.array(bucket[cuts].astype(np.int32)),
                "chunk": pa.array(np.full(len(cuts), chunk, np.int64)),
                "n": pa.array((ends - cuts).astype(np.int32)),
                "hashes": pa.array([pack_sorted(hashes[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
                "second": pa.array([second[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            }
        )

    return send


def _answer(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, a bit for each of its hashes, set where a
    chunk of an earlier range has the hash."""
    chunks = table.column("chunk").to_numpy()
    order = np.argsort(chunks, kind="stable")
    sizes = table.column("n").to_numpy()[order].astype(np.int64)
    blobs, seconds = table.column("hashes").combine_chunks(), table.column("second").combine_chunks()
    hashes = np.concatenate([unpack_sorted(blobs[int(i)].as_buffer(), int(n)) for i, n in zip(order, sizes)])
    second = np.concatenate([np.frombuffer(seconds[int(i)].as_buffer(), np.uint16) for i in order])
    span = np.repeat(chunks[order] >> PARTS_SHIFT, sizes)
    by_hash = np.argsort(hashes, kind="stable")  # rows came in the order of ranges, so the earliest leads each run
    h, s = hashes[by_hash], second[by_hash]
    if np.any((h[1:] == h[:-1]) & (s[1:] != s[:-1])):
        by_hash = np.lexsort((second, hashes))
        h, s = hashes[by_hash], second[by_hash]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    begins = np.flatnonzero(new)
    seen = np.zeros(len(h), bool)
    seen[by_hash] = span[by_hash] > np.repeat(span[by_hash[begins]], np.diff(np.append(begins, len(h))))
    ends = np.cumsum(sizes)
    return pa.table(
        {
            "chunk": table.column("chunk").take(pa.array(order)),
            "bucket": table.column("bucket").take(pa.array(order)),
            "n": pa.array(sizes.astype(np.int32)),
            "seen": pa.array([np.packbits(seen[e - n : e]).tobytes() for e, n in zip(ends, sizes)], pa.binary()),
        }
    )


def _runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _mark(window: int, as_is: bool):
    def mark(table: pa.Table, answers: pa.Table) -> pa.Table:
        rank, order, texts = _in_id_order(table)
        found = _windows(texts, window)
        by_hash, begins = _distinct(found.hashes)
        flags = np.zeros(len(begins), bool)
        if answers.num_rows:
            by_bucket = np.argsort(answers.column("bucket").to_numpy())
            bits, sizes = answers.column("seen").combine_chunks(), answers.column("n").to_numpy()
            flags = np.concatenate([np.unpackbits(np.frombuffer(bits[int(i)].as_buffer(), np.uint8), count=int(sizes[i])) for i in by_bucket]).astype(bool)
        lengths = np.diff(np.append(begins, len(by_hash)))
        owner = rank[found.text]
        repeated = np.empty(len(by_hash), bool)
        repeated[by_hash] = np.repeat(flags, lengths) | (owner[by_hash] > np.repeat(owner[by_hash[begins]], lengths))
        n_words, n_removed, kept = [], [], []
        spans, cuts, at = [0], ([], []), 0
        for _, words, starts in found.runs:
            mine = starts[repeated[at : at + len(starts)]]
            at += len(starts)
            cover = np.zeros(words.count + 1, np.int32)
            np.add.at(cover, mine, 1)
            np.add.at(cover, mine + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            raw = words.buffer.tobytes()
            for a, b in zip(words.first[:-1], words.first[1:]):
                own = gone[a:b]
                count = int(own.sum())
                if as_is and not count:
                    kept.append(None)  # the text itself, below
                elif a == b or count == b - a:
                    kept.append(b"")
                elif not count:
                    kept.append(raw[words.starts[a] : words.ends[b - 1]])
                else:
                    kept.append(b" ".join([raw[words.starts[a + x] : words.ends[a + y - 1]] for x, y in zip(*_runs_of(~own))]))
                if count:
                    x, y = _runs_of(own)
                    cuts[0].append(x)
                    cuts[1].append(y)
                    spans.append(spans[-1] + len(x))
                else:
                    spans.append(spans[-1])
                n_words.append(int(b - a))
                n_removed.append(count)
        kept_text = pa.array(kept, pa.binary()).cast(pa.string())
        if as_is:
            given = table.column("text").combine_chunks().cast(pa.string()).take(pa.array(order))
            kept_text = pc.if_else(pa.array(np.array(n_removed) == 0), given, kept_text)
        flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in cuts]
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(pa.array(order)),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_text": kept_text,
                "removed": pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.StructArray.from_arrays(flat, ["start", "end"])),
                **{c: table.column(c).take(pa.array(order)) for c in table.column_names if c.startswith(_CARRIED)},
            }
        )

    return mark


def _cuts(most: float):
    """Of rows (id, bytes) in the order of ids, each id at which ``most`` bytes are full."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = 0.0
        for part in parts:
            found = []
            for key, size in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                full += size
                times = int(full // most)
                found += [key] * times
                full -= times * most
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["id"])

    return run


def _chunked(docs: DataFrame, rows: int, size: int, chunks: int) -> DataFrame:
    """Deal documents into ``chunks`` ranges of ids with about as many bytes each.

    The ranges end at ids of a sample by hash, SAMPLE rows a chunk or SAMPLED in all
    (below that, of all rows); the
    driver gets one id a chunk (chunk_size keeps them under half a million at
    100 TB).  An id, or the null ids, with bytes for several chunks is a range of
    its own whose rows are dealt by text; the parts of a range don't count as
    earlier than one another.
    """
    docs = docs.withColumn("order_id", F.coalesce("doc_id", F.lit(LAST_ID)))
    share = min(1.0, max(SAMPLE * chunks, SAMPLED) / max(rows, 1))
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    taken = (docs if share == 1 else docs.where(key < F.lit(int(share * (1 << 40))))).select("order_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    cuts: list[int] = []
    if chunks > 1 and size:
        ranged = taken.repartitionByRange(max(1, min(shuffle_partitions(docs.sparkSession), chunks // 4)), "order_id", "n").sortWithinPartitions("order_id", "n")
        cuts = [r.id for r in ranged.mapInArrow(_cuts(size * share / chunks), "id long").collect()]
    times = Counter(float(c) for c in cuts)
    splits = sorted({-math.inf, math.inf, *times, *(np.nextafter(c, math.inf) for c, n in times.items() if n > 1)})
    if len(splits) < 3:
        return docs.withColumn("chunk", F.lit(0).cast("long"))
    at = Bucketizer(splits=[float(x) for x in splits], inputCol="__at", outputCol="__span").transform(docs.withColumn("__at", F.col("order_id").cast("double")))
    wide = [(k, times[x]) for k, x in enumerate(splits) if times.get(x, 0) > 1]
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in wide for v in pair]), F.col("__span").cast("int")), F.lit(1)) if wide else F.lit(1)
    chunk = F.shiftleft(F.col("__span").cast("long"), PARTS_SHIFT) + F.pmod(F.xxhash64("text"), parts)
    return at.withColumn("chunk", chunk).drop("__at", "__span")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, chunk_bytes: int | None = None, carry: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (the words
    that stay, joined by single spaces), removed (maximal intervals [start, end)
    of word positions) and the input's columns ``carry``.  With ``as_is`` the
    kept_text of a row that loses nothing is its text, null if it is null.

    Words are runs of anything but ASCII white space, unchanged.  A word goes if
    a window over it also starts in a document with a smaller id; windows are
    judged on the input.  Null and empty texts have no words.  Texts shorter
    than a window keep everything.  Rows that share an id are not "smaller" than
    each other, so repeated rows stay; null ids count as larger than all others
    and as equal to each other.  An empty table gives an empty result; other
    columns are ignored.  ``chunk_bytes`` is the text a task holds at once
    (common.chunk_size unless given).
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    kinds = dict(docs.dtypes)
    carried = {f"{_CARRIED}{k}": c for k, c in enumerate(carry or [])}
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *(docs[c].alias(k) for k, c in carried.items()))
    rows, size = text_bytes(base)
    parts = max(shuffle_partitions(docs.sparkSession), -(-size // (chunk_bytes or chunk_size(size))))
    dealt = _chunked(base, rows, size, parts)
    by_chunk = dealt.groupBy("chunk")  # the same columns both times, so that one exchange serves both
    sent = by_chunk.applyInArrow(_send(window, parts), "bucket int, chunk long, n int, hashes binary, second binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, n int, seen binary")
    shape = ", ".join([RESULT, *(f"{k} {kinds[c]}" for k, c in carried.items())])
    found = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_mark(window, as_is), shape)
    return found.withColumnsRenamed(carried) if carried else found
