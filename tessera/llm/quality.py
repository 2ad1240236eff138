"""Quality classifier: random-indexing word vectors, a two-layer network,
temperature-calibrated probabilities.

Tokens are runs of letters, digits or other marks, hashed into ROWS rows: words
that share a row (few of the frequent ones do) share a vector.  Each row has a
sparse ternary index vector; a word's vector is the sum of the index vectors next
to its occurrences, counted over the whole corpus in one pass and added up in a
tree, so no task gathers more than a fixed number of partial sums.  A document is
pooled from its words' vectors alone: their mean, shrunk for short texts, the mean
of their squares, and the mean product of neighbours.  The network is fitted in numpy on a bounded sample of labelled rows (``max_train_rows``, those
with the smallest hash of their id); everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textops
from tessera.llm.common import SUMS, bounded_sample, checkpoint, documents, pack_sums, split_join, tree_summed, unpack_sums

#: Rows of the word table (a documented parameter, 8 MB of vectors), and what a
#: document's mean is shrunk by, in tokens.
ROWS, DIMS, NONZERO, BLOCKS, SHRINK = 1 << 16, 64, 4, 64, 8
#: Training rows up to which they are broadcast: 12 bytes each.
BROADCAST_ROWS = 1_000_000
SEED = 7
FEATURES = 3 * DIMS


def _classes() -> np.ndarray:
    """Kind of each byte: 0 white space, 1 letter (bytes of multi-byte
    characters too), 2 digit, 3 other mark, 4 capital letter."""
    kind = np.full(256, 3, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[97:123] = kind[128:] = 1
    kind[65:91] = 4
    kind[48:58] = 2
    return kind


_KIND = _classes()


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row of each token, first token of each text and the total).  A token is a
    maximal run of one kind of byte; a single capital belongs to what follows."""
    joined = b" ".join(texts) + b" "
    buffer = np.frombuffer(joined + b"\0" * 8, np.uint8)
    kind = _KIND[buffer[: len(joined)]]
    letter = (kind == 1) | (kind == 4)
    shape = np.where(letter, np.uint8(1), kind)
    change = np.flatnonzero(np.diff(shape, prepend=np.uint8(0)))
    bounds = np.append(change, len(joined))
    solid = shape[change] != 0
    starts, ends = bounds[:-1][solid], bounds[1:][solid]
    rows = (textops.xxh64_spans(buffer, starts, ends, SEED) % np.uint64(ROWS)).astype(np.int64)
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return rows, np.searchsorted(starts, edges)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each row's index vector."""
    random = np.random.default_rng(SEED)
    return random.integers(0, DIMS, (ROWS, NONZERO)), random.choice(np.array([-1, 1], np.int32), (ROWS, NONZERO))


def _context_sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    sums = np.zeros(ROWS * DIMS, np.int32)
    for part in parts:
        for _, run in textops.batches(textops.Texts(part.column(0))):
            rows, first = tokens(run)
            inside = np.ones(max(0, len(rows) - 1), bool)
            cut = first[1:-1]
            inside[cut[(cut > 0) & (cut < len(rows))] - 1] = False
            left, right = rows[:-1][inside], rows[1:][inside]
            for word, context in ((left, right), (right, left)):
                for k in range(NONZERO):
                    np.add.at(sums, word * DIMS + places[context, k], signs[context, k])
    me = TaskContext.get().partitionId()
    for number, block in enumerate(sums.reshape(BLOCKS, -1)):
        if block.any():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([me], pa.int32()), pa.array([pack_sums(block)], pa.binary())], ["block", "part", "sums"])


def _single(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        packed = [unpack_sums(blob.as_py()).astype(np.float32).tobytes() for blob in part.column(2)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["block", "sums"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(ROWS, DIMS) unit vectors, centred, in half precision: 8 MB whatever the
    corpus.  The driver takes the sums block by block, 16 MB in all."""
    source = docs.select(F.col(text_col).alias("text"))
    parts = source.rdd.getNumPartitions()
    vectors = np.zeros((BLOCKS, ROWS // BLOCKS * DIMS), np.float32)
    for row in tree_summed(source.mapInArrow(_context_sums, SUMS), parts).mapInArrow(_single, "block int, sums binary").toLocalIterator():
        vectors[row.block] = np.frombuffer(row.sums, np.float32)
    vectors = vectors.reshape(ROWS, DIMS)
    mass = np.linalg.norm(vectors, axis=1)
    vectors /= np.maximum(mass, 1e-9)[:, None]
    weight = np.sqrt(mass)
    centre = weight @ vectors / max(weight.sum(), 1e-9)
    vectors[mass > 0] -= centre
    return vectors.astype(np.float16)


def pool(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Of each text's word vectors: the sum over count + SHRINK, the mean square
    and the mean product of neighbours; zeros without words."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for at, run in textops.batches(texts):
        rows, first = tokens(run)
        size = np.diff(first)
        for k in np.flatnonzero(size).tolist():
            own = vectors.take(rows[first[k] : first[k + 1]], axis=0).astype(np.float32)
            n = len(own)
            out[at + k, :DIMS] = np.add.reduce(own, axis=0) / (n + SHRINK)
            out[at + k, DIMS : 2 * DIMS] = np.einsum("td,td->d", own, own) / n
            out[at + k, 2 * DIMS :] = np.einsum("td,td->d", own[:-1], own[1:]) / max(n - 1, 1)
    return out


def document_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = pool(textops.Texts(part.column(1)), shared.value)
            packed = pa.array([row.tobytes() for row in found.astype(np.float16)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), packed], ["doc_id", "text_md5", "features"])

    digest = F.md5(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", "text", digest.alias("text_md5")).mapInArrow(run, "doc_id long, text_md5 string, features binary")


class Network:
    """features -> tanh layer -> logit; temperature fitted on rows left out."""

    def __init__(self, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, seed: int = SEED):
        self.hidden, self.epochs, self.rate, self.seed = hidden, epochs, rate, seed
        self.temperature, self.weights = 1.0, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        if not len(y):
            return self
        random = np.random.default_rng(self.seed)
        order = random.permutation(len(y))
        held = order[: len(y) // 5]
        learn = order[len(y) // 5 :] if len(y) >= 10 else order
        known = x[learn]
        self.mean, self.scale = known.mean(0, dtype=np.float64), known.std(0, dtype=np.float64) + 1e-6
        del known
        z = x.astype(np.float32)  # the rows once more, and no further copy
        z -= self.mean
        z /= self.scale
        n = x.shape[1]
        w = [random.normal(0, n**-0.5, (n, self.hidden)), np.zeros(self.hidden), random.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        first, second, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
        for _ in range(self.epochs):
            for batch in np.array_split(random.permutation(learn), max(1, len(learn) // 256)):
                a = np.tanh(z[batch] @ w[0] + w[1])
                error = (1 / (1 + np.exp(-(a @ w[2] + w[3]))) - y[batch]) / len(batch)
                back = np.outer(error, w[2]) * (1 - a * a)
                gradients = [z[batch].T @ back + 1e-4 * w[0], back.sum(0), a.T @ error + 1e-4 * w[2], error.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(gradients):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    w[k] = w[k] - self.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        if len(y) >= 10:
            logits = self.logits(x[held])
            tries = np.geomspace(0.25, 8, 61)
            loss = [np.mean(np.logaddexp(0, -np.where(y[held] > 0, logits, -logits) / t)) for t in tries]
            self.temperature = float(tries[int(np.argmin(loss))])
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        a = np.tanh((x - self.mean) / self.scale @ self.weights[0] + self.weights[1])
        return a @ self.weights[2] + self.weights[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(True))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, max_train_rows: int = 20_000) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, text_md5.

    Learns from labelled rows whose crc32(id) mod 5 is not 0, at most
    ``max_train_rows`` of them; a document with several labels has the largest,
    null labels count as none; of rows that share an id one text is learned from,
    that with the smallest digest.  Only the text enters a score.  Null and empty
    texts are pooled to zeros and scored like any other.  Without usable labels
    each score is 0.5.  Repeated rows get equal scores, null ids are held out.
    An empty table gives an empty result; other columns are ignored.
    """
    base = documents(docs, id_col, text_col)
    pooled = checkpoint(document_vectors(base, word_vectors(base)))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = bounded_sample(known, "doc_id", known.count(), max_train_rows)
    # the sample is bounded by max_train_rows, so it goes to the rows while it is small
    met = pooled.join(F.broadcast(sample), "doc_id") if max_train_rows <= BROADCAST_ROWS else split_join(pooled, sample, "doc_id")
    rows = met.groupBy("doc_id", "y").agg(F.min_by("features", "text_md5").alias("features")).orderBy("doc_id").select("features", "y").collect()
    x, y = np.zeros((len(rows), FEATURES), np.float32), np.array([r.y for r in rows], np.float64)
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(r.features, np.float16)
    del rows
    network = Network().fit(x, y)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.frombuffer(b"".join(part.column(2).to_pylist()), np.float16).reshape(part.num_rows, FEATURES).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(network.scores(found).astype(np.float64))], ["doc_id", "text_md5", "score"])

    scored = pooled.mapInArrow(run, "doc_id long, text_md5 string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_md5")
