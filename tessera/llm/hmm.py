"""Language-model scoring with a hidden Markov model over word classes.

Vocabulary counts are exact and distributed: documents are dealt into chunks,
a chunk sends its distinct words (as hashes) with their training counts to
hash-range buckets, a bucket adds them up and answers each chunk with the totals
of the chunk's own words.  So no table of words is ever broadcast, and a word
that fills the corpus costs one entry a chunk.

A word is emitted in two steps: its state picks a class, the class picks the
word in proportion to count + 1, with one share for unseen words.  The most
frequent words are classes of their own, the others share classes by their last
bytes; the number of classes is fixed, hence so is the model.  Baum-Welch starts
from a random model that no data enter and runs over all training documents in
every pass: each task returns expected counts, which are added up in a tree.
Neither training nor scoring cuts a document: forward and backward recursions run
over its whole length, and long ones keep the forward state at intervals only and
compute what lies between again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textops
from tessera.llm.common import SUMS, checkpoint, chunk_size, documents, pack_sums, shuffle_partitions, text_bytes, tree_sum
from tessera.llm.quality import held_out
from tessera.llm.substring_dedup import _bucket_of, pack_sorted, unpack_sorted

END_CLASS, TAILS, TOPS = 0, 1024, 2000
WORD_SEED, TAIL_SEED = 1, 3
#: Words are never white space, so this stands for the end of a text.
END_HASH = 0x2545F4914F6CDD1D
#: Tokens whose state probabilities are held at once, documents that are worked off in
#: step whatever their length, tokens of documents that are sorted together, and the
#: share of all tokens from which a word may be a class of its own.
_BLOCK, _WIDE, _SORTED, OFTEN = 1 << 19, 64, 1 << 22, 1 / 20_000

TOTALS = "kind int, chunk int, bucket int, n long, data binary"
ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, word_part double, classes binary"


def _planes(values: np.ndarray) -> bytes:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(blob, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * n).reshape(4, n).T).view("<u4").reshape(-1)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, tail class, first token of each text and the total); each text ends
    with one end token.  A-Z become a-z."""
    hashes, tails, firsts, at = [], [], [np.zeros(1, np.int64)], 0
    for _, run in textops.batches(texts):
        words = textops.to_words(run, lower=True)
        first = words.first + np.arange(len(run) + 1)
        place = np.arange(words.count) + words.text_of_word()
        h = np.full(first[-1], END_HASH, np.uint64)
        t = np.full(first[-1], END_CLASS, np.uint16)
        h[place] = textops.xxh64_spans(words.buffer, words.starts, words.ends, WORD_SEED)
        tail = textops.xxh64_spans(words.buffer, np.maximum(words.starts, words.ends - 3), words.ends, TAIL_SEED)
        t[place] = 1 + (tail % np.uint64(TAILS)).astype(np.uint16)
        hashes.append(h)
        tails.append(t)
        firsts.append(first[1:] + at)
        at += first[-1]
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), firsts[0]
    return np.concatenate(hashes), np.concatenate(tails), np.concatenate(firsts)


def _texts(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    return textops.as_bytes(table.column("text").combine_chunks()), table.column("held_out").to_numpy().astype(bool)


def _count(buckets: int):
    def count(table: pa.Table) -> pa.Table:
        texts, held = _texts(table)
        hashes, tails, first = _tokens(texts)
        known, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        counts = np.bincount(inverse, np.repeat(~held, np.diff(first)), len(known)).astype(np.int64)
        bucket = _bucket_of(known, buckets)
        cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(2**63)))
        ends = np.append(cuts[1:], len(bucket))
        blobs = lambda f: pa.array([f(a, b) for a, b in zip(cuts, ends)], pa.binary())
        return pa.table(
            {
                "bucket": pa.array(bucket[cuts].astype(np.int32)),
                "chunk": pa.array(np.full(len(cuts), table.column("chunk")[0].as_py(), np.int32)),
                "n": pa.array((ends - cuts).astype(np.int32)),
                "hashes": blobs(lambda a, b: pack_sorted(known[a:b])),
                "tails": blobs(lambda a, b: tails[at[a:b]].tobytes()),
                "counts": blobs(lambda a, b: _planes(counts[a:b])),
            }
        )

    return count


def _totals():
    """Of one bucket: totals for each chunk (kind 0), tokens and distinct known
    words by tail class (kind 1), and the most frequent words (kind 2)."""

    def totals(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        bucket, sizes = table.column("bucket")[0].as_py(), table.column("n").to_pylist()
        column = {c: table.column(c).combine_chunks() for c in ("hashes", "tails", "counts")}
        hashes = np.concatenate([unpack_sorted(column["hashes"][i].as_buffer(), n) for i, n in enumerate(sizes)])
        tails = np.concatenate([np.frombuffer(column["tails"][i].as_buffer(), np.uint16) for i in range(len(sizes))])
        counts = np.concatenate([_from_planes(column["counts"][i].as_buffer(), n) for i, n in enumerate(sizes)])
        known, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(inverse, counts, len(known)).astype(np.int64)
        tail = tails[at].astype(np.int64)
        stats = np.stack([np.bincount(tail, total, TAILS + 1), np.bincount(tail, total > 0, TAILS + 1)])
        # a word with OFTEN of all tokens has it of its bucket's, and TOPS are taken in all
        often = np.flatnonzero((total >= max(1.0, OFTEN * total.sum())) & (tail != END_CLASS))
        often = often[np.lexsort((known[often], -total[often]))][:TOPS]
        spread, ends = total[inverse], np.cumsum(sizes)
        rows = [(0, c, n, spread[e - n : e].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()) for c, n, e in zip(table.column("chunk").to_pylist(), sizes, ends)]
        rows.append((1, -1, 0, pack_sums(stats)))
        rows.append((2, -1, len(often), np.stack([known[often], tail[often].astype(np.uint64), total[often].astype(np.uint64)]).tobytes()))
        kind, chunk, n, data = zip(*rows)
        return pa.table({"kind": pa.array(kind, pa.int32()), "chunk": pa.array(chunk, pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "n": pa.array(n, pa.int64()), "data": pa.array(data, pa.binary())})

    return totals


def _frequent(least: float):
    """Of buckets' most frequent words those with ``least`` tokens: (hash, tail, n)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for blob in part.column(0).to_pylist():
                hashes, tails, counts = np.frombuffer(blob, np.uint64).reshape(3, -1)
                kept = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(v[kept].view(np.int64)) for v in (hashes, tails, counts)], ["hash", "tail", "n"])

    return run


class Vocabulary:
    """The fixed-size part of the vocabulary: totals, tail classes, frequent words."""

    def __init__(self, stats: np.ndarray, often: list[tuple[int, int, int]]):
        tokens, words = stats[0].copy(), stats[1].copy()
        self.tokens, self.words = float(tokens.sum()), float(words.sum())
        for _, tail, count in often:
            tokens[tail] -= count
            words[tail] -= 1
        self.share = tokens + words + 1  # of a tail class: counts + 1 of its words, and 1 for unseen ones
        order = np.argsort(np.array([h for h, _, _ in often], np.uint64))
        self.often = np.array([h for h, _, _ in often], np.uint64)[order]
        self.classes = 1 + TAILS + TOPS

    def classify(self, hashes: np.ndarray, tails: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, log10 of the word's share of its class) of distinct words."""
        kind = tails.astype(np.int64)
        share = np.log10((totals + 1) / self.share[kind])
        share[kind == END_CLASS] = 0
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, hashes), len(self.often) - 1)
            own = self.often[at] == hashes
            kind[own], share[own] = 1 + TAILS + at[own], 0
        return kind.astype(np.uint16), share


def _encode(vocabulary: Vocabulary):
    def encode(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, held = _texts(table)
        hashes, tails, first = _tokens(texts)
        known, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        totals = np.zeros(len(known), np.int64)
        done = 0
        answers = answers.sort_by("bucket")
        for n, blob in zip(answers.column("n").to_pylist(), answers.column("data").to_pylist()):
            totals[done : done + n] = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, n).T).view("<i8").reshape(-1)
            done += n
        kind, share = vocabulary.classify(known, tails[at], totals)
        base = np.log10((totals + 1) / (vocabulary.tokens + vocabulary.words + 1))
        begins = first[:-1]
        by_text = lambda v: np.add.reduceat(v[inverse], begins)  # noqa: E731  every text has its end token
        classes = kind[inverse]
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "held_out": table.column("held_out"),
                "n_tokens": pa.array(np.diff(first)),
                "n_known": pa.array(by_text((totals > 0).astype(np.int64))),
                "base": pa.array(by_text(base)),
                "word_part": pa.array(by_text(share)),
                "classes": pa.array([classes[a:b].tobytes() for a, b in zip(begins, first[1:])], pa.binary()),
            }
        )

    return encode


class Hmm:
    """Start, transition and emission probabilities; rows are states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def random(states: int, classes: int, seed: int = 11) -> Hmm:
        r = np.random.default_rng(seed)
        norm = lambda v: v / v.sum(axis=-1, keepdims=True)
        return Hmm(norm(1 + r.random(states)), norm(r.random((states, states)) + 4 * np.eye(states)), norm(0.5 + r.random((states, classes))))

    @property
    def size(self) -> int:
        s, k = self.emit.shape
        return s + s * s + s * k + 1

    def updated(self, counts: np.ndarray) -> Hmm:
        """Maximisation; a tenth of a count keeps every event possible."""
        s, k = self.emit.shape
        start, move, emit = counts[:s], counts[s : s + s * s].reshape(s, s), counts[s + s * s : -1].reshape(s, k)
        norm = lambda v: (v + 0.1) / (v + 0.1).sum(axis=-1, keepdims=True)
        return Hmm(norm(start), norm(move), norm(emit))

    def log_likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of each sequence's probability: scaled forward
        recursion, all sequences in step, longest first so the live ones lead."""
        sizes = np.array([len(q) for q in sequences])
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([sequences[i] for i in order]) if len(order) else np.zeros(0, np.uint16)
        lengths = sizes[order]
        first = np.cumsum(lengths) - lengths
        emit = np.ascontiguousarray(self.emit.T)
        out = np.zeros(len(order))
        live = int((lengths > 0).sum())
        if not live:
            return out
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        alpha = self.start * emit[flat[first[:live]]]
        for t in range(int(lengths[0])):
            if t:
                live = int(alive[t])
                alpha = (alpha[:live] @ self.move) * emit[flat[first[:live] + t]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            out[:live] += np.log(scale)
        result = np.empty_like(out)
        result[order] = out
        return result

    def expected_counts(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Baum-Welch statistics of whole sequences, and the log-likelihood, as
        one vector."""
        s, k = self.emit.shape
        total = np.zeros(self.size)
        rest = sorted((q for q in sequences if len(q)), key=len, reverse=True)
        while rest:
            n = min(len(rest), max(_WIDE, _BLOCK // len(rest[0])))
            self._add_counts(rest[:n], total[:s], total[s : s + s * s].reshape(s, s), total[s + s * s : -1].reshape(s, k), total[-1:])
            rest = rest[n:]
        return total

    def _add_counts(self, block: list[np.ndarray], start: np.ndarray, move: np.ndarray, emitted: np.ndarray, total: np.ndarray) -> None:
        """Sequences in step, longest first so that the live ones lead.  The first
        walk keeps the state before every segment; segments are then walked again,
        last one first, and met by the backward recursion."""
        n, lengths = len(block), np.array([len(q) for q in block])
        steps, (s, k) = int(lengths[0]), self.emit.shape
        emit, back = np.ascontiguousarray(self.emit.T), np.ascontiguousarray(self.move.T)
        seen = np.zeros((steps, n), np.uint16)
        for row, q in enumerate(block):
            seen[: len(q), row] = q
        alive = np.searchsorted(-lengths, -np.arange(steps + 1), side="left")
        span = max(1, _BLOCK // n)

        def forward(a: int, b: int, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            given = emit[seen[a:b]]
            alpha, scale = np.zeros((b - a, n, s)), np.ones((b - a, n))
            for t in range(b - a):
                m = alive[a + t]
                v = (self.start if state is None else state[:m] @ self.move) * given[t, :m]
                scale[t, :m] = v.sum(axis=1)
                state = alpha[t, :m] = v / scale[t, :m, None]
            return given, alpha, scale

        before, state = [], None
        for a in range(0, steps, span):
            before.append(state)
            if a + span < steps:
                state = forward(a, a + span, state)[1][-1].copy()
        beta = np.ones((n, s))
        ahead = None  # what the next step's emissions and beta bring, weighted by its scale
        for a in range((steps - 1) // span * span, -1, -span):
            b = min(a + span, steps)
            given, alpha, scale = forward(a, b, before.pop())
            for t in range(b - a - 1, -1, -1):
                m, after = alive[a + t], alive[a + t + 1]
                if after:
                    move += self.move * (alpha[t, :after].T @ ahead[:after])
                    beta[:after] = ahead[:after] @ back
                alpha[t, :m] *= beta[:m]
                ahead = given[t, :m] * beta[:m] / scale[t, :m, None]
            live = np.arange(n)[None, :] < alive[a:b, None]
            where, weight = seen[a:b][live], alpha[live]
            for state_ in range(s):
                emitted[state_] += np.bincount(where, weight[:, state_], k)
            total += np.log(scale).sum()
            if not a:
                start += alpha[0].sum(axis=0)


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint16) for v in column.to_pylist()]


def _groups(sequences: list[np.ndarray], most: int = _SORTED) -> Iterator[list[np.ndarray]]:
    group, size = [], 0
    for q in sequences:
        group.append(q)
        size += len(q)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _expectation(model: Hmm):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(model.size)
        for part in parts:
            for group in _groups(_sequences(part.column(0))):
                total += model.expected_counts(group)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pack_sums(total)], pa.binary())], ["block", "part", "sums"])

    return run


def _score(model: Hmm):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = model.log_likelihoods(_sequences(part.column(6))) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(found + part.column(5).to_numpy())], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def hmm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = 8, passes: int = 6, chunk_bytes: int | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probability of the whole text under the model).

    Learns from rows whose crc32(id) mod 7 is not 2; those and rows with a null
    id are held out.  Every text ends with an end token, so null and empty texts
    have one token.  Repeated rows count as often as they occur and score alike.
    Without training rows the counts are zero and the model stays as it starts.
    An empty table gives an empty result; other columns are ignored.
    ``chunk_bytes`` is the text a task holds at once (common.chunk_size unless
    given); ``passes`` of Baum-Welch each read all training documents.
    """
    base = documents(docs, id_col, text_col)
    _, size = text_bytes(base)
    parts = max(shuffle_partitions(docs.sparkSession), -(-size // (chunk_bytes or chunk_size(size))))
    # by text too, so that rows that share an id, or have none, are dealt out
    dealt = base.select("doc_id", "text", held_out(F.col("doc_id"), 7, 2).alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("chunk"))
    sent = dealt.groupBy("chunk").applyInArrow(_count(parts), "bucket int, chunk int, n int, hashes binary, tails binary, counts binary")
    totals = checkpoint(sent.groupBy("bucket").applyInArrow(_totals(), TOTALS))
    by_bucket = totals.where("kind = 1").select(F.lit(0).alias("block"), F.col("bucket").alias("part"), F.col("data").alias("sums"))
    stats = tree_sum(by_bucket, parts).get(0, np.zeros(2 * (TAILS + 1))).reshape(2, -1)
    # at most 1 / OFTEN words reach that share of all tokens
    often = totals.where("kind = 2").select("data").mapInArrow(_frequent(OFTEN * float(stats[0].sum())), "hash long, tail long, n long")
    often = often.orderBy(F.desc("n"), "hash").limit(TOPS).collect()
    vocabulary = Vocabulary(stats, [(r.hash % 2**64, r.tail, r.n) for r in often])

    answers = totals.where("kind = 0").drop("kind")
    encoded = checkpoint(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_encode(vocabulary), ENCODED))
    training = encoded.where(~F.col("held_out")).select("classes")
    model = Hmm.random(states, vocabulary.classes)
    n = encoded.rdd.getNumPartitions()
    for _ in range(passes):
        found = tree_sum(training.mapInArrow(_expectation(model), SUMS), n)
        model = model.updated(found.get(0, np.zeros(model.size)))
    scored = encoded.mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(vocabulary.tokens)).cast("long").alias("train_tokens"), "base_score", "score")
