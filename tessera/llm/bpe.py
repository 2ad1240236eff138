"""BPE encoding and decoding with word ends, equal to the tokenizers library.

White space parts a text into chunks, which no word reaches across.  Arrow finds the
distinct chunks of a batch; these alone are split into words, and a text's ids are
gathered from those of its chunks.  Distinct words are encoded together: words of one length form a
matrix of parts and a matrix of ranks of adjacent parts.  Each round scans every
row for its first minimum, deletes that boundary and refreshes the two
neighbouring ranks; all rows lose one part a round, so the arrays stay
contiguous.  Words over LONG_WORD bytes take a heap instead, in n log n.
Encoded words are remembered in a table of bounded size.

The vocabulary file is read by the driver and sent to the workers as one
broadcast of checked size; no worker opens a path.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents

LONG_WORD = 64
CACHED_WORDS = 150_000
MAX_VOCABULARY_BYTES = 64 << 20
_BATCH = 4 << 20
NONE = np.int32(2**31 - 1)

# What the vocabulary's own pre-tokenizer splits a text into.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same over plain characters, among which re's classes and Unicode's agree.
PLAIN_WORD = re.compile(r"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\s\w]|_)+")
#: What ends a chunk among words, and among ids; what stands for it in the library's splits.
END, END_ID, END_MARK = "\n", np.uint32(2**32 - 1), "\ue000"
PLAIN_WORD_OR_END = re.compile(PLAIN_WORD.pattern + "|" + END)


def _plain_table() -> np.ndarray:
    """Which code points below U+2070 are plain: Latin letters, ASCII and common
    punctuation, without superscripts, fractions and separator controls.  Texts
    with others are split by the library's own rules, whose Unicode tables may
    differ from this Python's."""
    plain = np.zeros(0x2070, bool)
    for first, last in ((0x00, 0x1B), (0x20, 0x84), (0x86, 0xB1), (0xB4, 0xB8), (0xBA, 0xBB), (0xBF, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E)):
        plain[first : last + 1] = True
    return plain


PLAIN = _plain_table()


def is_plain(text: str) -> bool:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return not len(points) or bool(points.max() < len(PLAIN) and PLAIN[points].all())


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: visible Latin-1
    characters stand for themselves, the rest are numbered from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class Encoder:
    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("only plain BPE vocabularies with word ends are supported")
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self._special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._build_ranks(left << np.uint64(32) | right)
        self._library = None
        self._content = content
        self.cache: dict[str, bytes] = {}

    # -- ranks of pairs: a table of small buckets, looked up a column at a time

    def _build_ranks(self, keys: np.ndarray) -> None:
        keys, first = np.unique(keys, return_index=True)  # a pair that occurs twice keeps its first rank
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        slot, keys, first = slot[order], keys[order], first[order]
        begins = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(begins, np.diff(np.append(begins, len(slot))))
        depth = int(place.max()) + 1 if len(place) else 1
        self._keys = np.full((depth, 1 << 17), 2**64 - 1, np.uint64)
        self._ranks = np.full((depth, 1 << 17), NONE, np.int32)
        self._keys[place, slot], self._ranks[place, slot] = keys, first

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = np.full(keys.shape, NONE, np.int32)
        for k, r in zip(self._keys, self._ranks):
            np.minimum(found, np.where(k[slot] == keys, r[slot], NONE), out=found)
        return found

    # -- words

    def _merge_equal_lengths(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """raw: bytes of words of one length, a row each.  Yields (rows, ids)."""
        rows = np.arange(len(raw))
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1 and len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                yield rows[done], ids[done]
                rows, ids, ranks, at, best = (x[~done] for x in (rows, ids, ranks, at, best))
                if not len(rows):
                    return
            n = np.arange(len(rows))
            ids[n, at] = self.merged[best]
            width = ids.shape[1] - 1
            column = np.arange(width)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            if width == 1:
                break
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < width - 1)
            ranks[right, at[right]] = self.ranks(ids[right, at[right]], ids[right, at[right] + 1])
        if len(rows):
            yield rows, ids

    def _merge_long(self, raw: bytes) -> np.ndarray:
        ids = [*self.inner[np.frombuffer(raw[:-1], np.uint8)].tolist(), int(self.last[raw[-1]])]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        first = self.ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        alive = [True] * len(ids)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.merged[r]), False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    rank = int(self.ranks(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if rank != NONE:
                        heapq.heappush(heap, (rank, x, ids[x], ids[y]))
        return np.array([t for t, live in zip(ids, alive) if live], np.int32)

    def learn(self, words: Iterable[str]) -> None:
        """Encode words and remember them, as little-endian 32-bit ids."""
        words = list(words)
        if not words:
            return
        packed = pa.array([w.encode() for w in words], pa.large_binary())
        data, ends = np.frombuffer(packed.buffers()[2], np.uint8), np.frombuffer(packed.buffers()[1], np.int64)[: len(words) + 1]
        lengths = np.diff(ends)
        order = np.argsort(lengths, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            length = int(lengths[same[0]])
            if length > LONG_WORD:
                self.cache.update((words[k], self._merge_long(words[k].encode()).astype("<u4").tobytes()) for k in same)
                continue
            for rows, ids in self._merge_equal_lengths(data[ends[same][:, None] + np.arange(length)]):
                packed, step = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
                parts = (packed[k : k + step] for k in range(0, len(packed), step))
                self.cache.update(zip(map(words.__getitem__, same[rows].tolist()), parts))

    # -- texts

    def _split_by_library(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            own = Tokenizer.from_str(self._content.decode())
            self._library = (own.normalizer, pre_tokenizers.Split(Regex(WORD), "removed", invert=True))
        normalizer, split = self._library
        return [w for w, _ in split.pre_tokenize_str(normalizer.normalize_str(text))]

    def _split_part(self, text: str, plain: bool) -> list[str]:
        if not plain and not is_plain(text):
            return self._split_by_library(text)
        return PLAIN_WORD.findall(text.lower())  # plain characters are in normal form already

    def split(self, text: str, plain: bool = False) -> list[str]:
        """The words of a text; special tokens stand for themselves.  ``plain``:
        its characters are known to be plain."""
        if self._special_split is None or "<|" not in text and not any(s in text for s in self.special):
            return self._split_part(text, plain)
        out: list[str] = []
        for part in self._special_split.split(text):
            out += [part] if part in self.special else self._split_part(part, plain) if part else []
        return out

    def _split_chunks(self, chunks: list[str]) -> tuple[list[str], list[int]]:
        """The words of all chunks, END after each chunk's, and the chunks' order:
        those of plain characters come first, as they are split at once."""
        joined = END.join([*chunks, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        odd = np.flatnonzero(~PLAIN[np.minimum(points, len(PLAIN) - 1)] | (points >= len(PLAIN)))
        unlike = set(np.searchsorted(np.flatnonzero(points == ord(END)), odd).tolist())
        special = {i for i, c in enumerate(chunks) if any(s in c for s in self.special)} if any(s in joined for s in self.special) else set()
        unlike -= special
        if not unlike and not special:
            return PLAIN_WORD_OR_END.findall(joined.lower()), list(range(len(chunks)))
        order = [i for i in range(len(chunks)) if i not in unlike and i not in special]
        words = PLAIN_WORD_OR_END.findall(END.join([*(chunks[i] for i in order), ""]).lower())
        if END_MARK in joined:
            special, unlike = special | unlike, set()
        if unlike:
            marked = "".join(f"{chunks[i]} {END_MARK} " for i in unlike)
            words += [END if w == END_MARK else w for w in self._split_by_library(marked)]
        for i in special:
            words += [*self.split(chunks[i]), END]
        return words, [*order, *unlike, *special]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; null counts as empty."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if any(any(map(str.isspace, s)) for s in self.special):  # a token that white space may part
            split = [self.split(t) for t in column.to_pylist()]
            self._remember(set().union(*split))
            return [b"".join(map(self.cache.__getitem__, words)) for words in split]
        pieces = pc.ascii_split_whitespace(column)
        last = np.append(0, np.cumsum(pc.list_value_length(pieces).to_numpy(), dtype=np.int64))
        coded = pieces.flatten().dictionary_encode()
        words, order = self._split_chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        self._remember(set(words).difference([END]))
        self.cache[END] = END_ID.tobytes()
        ids = np.frombuffer(b"".join(map(self.cache.__getitem__, words)), "<u4")
        ends = np.flatnonzero(ids == END_ID)
        begin, size = np.empty_like(ends), np.empty_like(ends)
        begin[order] = np.append(0, ends[:-1] + 1)[: len(ends)]
        size[order] = ends - begin[order]
        which = coded.indices.to_numpy()
        done = np.append(0, np.cumsum(size[which]))
        found = ids[np.repeat(begin[which] - done[:-1], size[which]) + np.arange(done[-1])]
        cuts = done[last].tolist()
        return [found[a:b].tobytes() for a, b in itertools.pairwise(cuts)]

    def _remember(self, used: set[str]) -> None:
        """See to it that the word table has these words."""
        if len(self.cache) > CACHED_WORDS:  # what these texts use stays, so frequent words are merged once
            self.cache = {w: self.cache[w] for w in used & self.cache.keys()}
        for token, i in self.special.items():
            self.cache[token] = np.array([i], "<u4").tobytes()
        self.learn(used.difference(self.cache))

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by single spaces: what a vocabulary without decoder gives."""
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[str, Encoder] = {}


def loaded(content: bytes) -> Encoder:
    """This worker's encoder, kept with its word table between tasks."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(content)
    return _LOADED[key]


def vocabulary(spark: SparkSession, path: str):
    """Broadcast the vocabulary file; it is refused over MAX_VOCABULARY_BYTES."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(content)


def encoded_batches(parts: Iterable[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids of documents, encoded texts) in pieces of about _BATCH bytes of text;
    a null text counts as empty."""
    for part in parts:
        texts = part.column(1)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
        begin = 0
        while begin < len(texts):
            end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _BATCH)) + 1
            keys = part.column(0).slice(begin, end - begin)
            yield keys, encoder.encode(texts.slice(begin, end - begin))
            begin += len(keys)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row.  Null and empty texts have no ids,
    repeated rows repeat, null ids stay null, other columns are ignored."""
    content = vocabulary(docs.sparkSession, path)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, encoded in encoded_batches(parts, loaded(content.value)):
            ends = np.cumsum([0, *(len(e) // 4 for e in encoded)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids decode to an empty text."""
    content = vocabulary(encoded.sparkSession, path)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(content.value)
        for part in parts:
            for row in range(part.num_rows):
                text = encoder.decode(part.column(1)[row].as_py() or [])
                yield pa.RecordBatch.from_arrays([part.column(0).slice(row, 1), pa.array([text])], ["doc_id", "text"])

    rows = encoded.select(encoded[id_col].cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, decode the ids again and report digests of both, so that
    neither leaves the worker: doc_id, n_tokens, ids_sha256 (decimal ids joined
    by single spaces), decoded_sha256.  Edge cases as in bpe_encode."""
    content = vocabulary(docs.sparkSession, path)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(content.value)
        decimal = list(map(str, range(len(encoder.tokens))))
        for keys, encoded in encoded_batches(parts, encoder):
            counts, written, decoded = [], [], []
            for packed in encoded:
                ids = np.frombuffer(packed, "<u4").tolist()
                counts.append(len(ids))
                written.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            columns = [keys, pa.array(counts, pa.int64()), pa.array(written), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
