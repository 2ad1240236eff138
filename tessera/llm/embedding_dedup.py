"""Embedding near-dedup by sorted projection passes.

Each pass orders the vectors of a label lexicographically by concatenated random
hyperplane hashes and compares every vector with its neighbours in that order,
WINDOW and more of them, in double precision.  Verified pairs of all passes are
united into components.  The number of passes follows from the largest label:
a pair at the threshold agrees in the leading bits that cut a label down to a
window with a known probability, and passes are added until missing it in all
of them is less likely than ``miss``.  That holds however the vectors lie, if all
rows that share those bits meet: where more of them do than a window reaches (a
label whose vectors point much the same way), all rows outside the largest
component found so far are compared with the whole run, or with the whole label
where that is less work.

Links are then counted inside components, where dense groups would need all
pairs.  A vector within half the threshold angle of the component's pivot links
with every other such vector (triangle inequality on the sphere), so this core
is counted, not compared.  Only the rest is compared with its component, in
blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, shuffle_partitions, split_join
from tessera.llm.components import connected_components

WINDOW, SEED, BLOCK, TILE = 64, 5, 512, 512
_EDGES = "a long, b long"


def leading_bits(rows: int) -> int:
    return max(1, math.ceil(math.log2(max(2.0, rows / WINDOW))))


def passes_needed(rows: int, threshold: float, miss: float) -> int:
    agree = (1 - math.acos(threshold) / math.pi) ** leading_bits(rows)
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Unit rows in double precision of a column of packed numbers of a kind."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(passes: int, kind: str, vectors: bool = True):
    """Sort keys of every pass: (label, dims, pass, key, rep) and, with ``vectors``, vector."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for part in parts:
            label, rep, flat = part.column(0), part.column(1), part.column(2)
            sizes = np.diff(flat.offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dims)
                mine = flat.take(pa.array(rows))
                x = mine.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dims)
                packed = [pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())] if vectors else []
                for number in range(passes):
                    if (number, dims) not in planes:
                        planes[number, dims] = np.random.default_rng([SEED, number, dims]).normal(size=(dims, 64))
                    key = np.packbits(x @ planes[number, dims] > 0, axis=1).view(">i8").reshape(-1).astype(np.int64)
                    fixed = [pa.array(np.full(len(rows), v, np.int32)) for v in (dims, number)]
                    yield pa.RecordBatch.from_arrays([label.take(pa.array(rows)), *fixed, pa.array(key), rep.take(pa.array(rows)), *packed], ["label", "dims", "pass", "key", "rep", "vector"][: 5 + vectors])

    return run


def _united(x: np.ndarray, ids: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare rows with their neighbours, block by block; of each block's links
    yield a forest that connects the same rows: (smallest id, id)."""
    for lo in range(0, len(x), WINDOW):
        block = x[lo : lo + 2 * WINDOW + WINDOW]
        close = block @ block.T >= threshold
        np.fill_diagonal(close, True)
        if int(close.sum()) == len(block):
            continue
        own = ids[lo : lo + len(block)]
        least = own
        while True:
            new = np.where(close, least[None, :], np.int64(2**63 - 1)).min(axis=1)
            if np.array_equal(new, least):
                break
            least = new
        differ = least != own
        yield least[differ], own[differ]


def _windows(threshold: float, kind: str):
    """Rows come sorted; each (label, dims, pass) run is compared in windows, with
    the last rows of a batch carried into the next.  Where two tasks meet inside
    a run, a pair that the cut parts is left to the other passes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for part in parts:
            table = pa.Table.from_batches([part])
            if carry is not None:
                table = pa.concat_tables([carry, table]).combine_chunks()
            label, dims, number = (table.column(c).to_numpy() for c in ("label", "dims", "pass"))
            new = np.flatnonzero((np.diff(label) != 0) | (np.diff(dims) != 0) | (np.diff(number) != 0)) + 1
            edges = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            ids = table.column("rep").to_numpy()
            for a, b in zip([0, *new], [*new, table.num_rows]):
                vectors = table.column("vector").slice(a, b - a).combine_chunks()
                edges += _united(_matrix(vectors, kind), ids[a:b], threshold)
            carry = table.slice(max(table.num_rows - 2 * WINDOW, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[k] for e in edges])) for k in (0, 1)], ["a", "b"])

    return run


def _meet(threshold: float, kind: str):
    """Of one block of asking and one of answering rows, the components that links join."""

    def meet(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy().astype(bool)
        x, component = _matrix(table.column("vector").combine_chunks(), kind), table.column("component").to_numpy()
        i, j = np.nonzero(x[asks] @ x[~asks].T >= threshold)
        pairs = np.unique(np.stack([component[asks][i], component[~asks][j]], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return meet


def _wide_runs(keys: DataFrame, packed: DataFrame, placed: DataFrame, bits: int, threshold: float, kind: str) -> DataFrame:
    """Links (a, b) between components that share a run of equal leading bits
    longer than the windows reach.  keys: (label, dims, pass, key, rep)."""
    run = ["label", "dims", "pass", "prefix"]
    rows = keys.select("label", "dims", "pass", F.shiftright("key", 64 - bits).alias("prefix"), "rep")
    long = rows.groupBy(run).agg(F.count(F.lit(1)).alias("n")).where(f"n > {2 * WINDOW}").select(run)
    touched = long.select("label", "dims").distinct()
    found = split_join(rows, long, run)
    # a label as a whole is one more run, numbered pass -1
    whole = split_join(rows.where("pass = 0"), touched, ["label", "dims"]).withColumns({"pass": F.lit(-1), "prefix": F.lit(0).cast("long")})
    found = split_join(found.unionByName(whole.select(found.columns)), placed, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    found = checkpoint(found)
    sizes = found.groupBy(*run, "component").agg(F.count(F.lit(1)).alias("n"))
    runs = sizes.groupBy(run).agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n")).where("n > most.n")
    runs = runs.select(*run, F.col("most.component").alias("lead"), "n", (F.col("n") - F.col("most.n")).alias("rest"))
    work = F.col("n").cast("double") * F.col("rest")
    cheap = runs.groupBy("label", "dims").agg((F.sum(F.when(F.col("pass") >= 0, work)) < F.sum(F.when(F.col("pass") < 0, work))).alias("by_run"))
    runs = runs.join(cheap, ["label", "dims"]).where("by_run = (pass >= 0)")
    blocks = lambda count: F.ceil(F.col(count) / BLOCK).cast("int")
    found = split_join(found, runs, run).withColumns({"asked": blocks("rest"), "answering": blocks("n"), "place": F.pmod(F.xxhash64("rep"), F.lit(1 << 30))})
    found = split_join(found, packed.select("rep", "vector"), "rep")
    to_all = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    asks = found.where("component <> lead").withColumns({"i": F.expr("int(place % asked)"), "j": to_all("answering"), "asks": F.lit(True)})
    answers = found.withColumns({"j": F.expr("int(place % answering)"), "i": to_all("asked"), "asks": F.lit(False)})
    met = asks.unionByName(answers).select(*run, "i", "j", "component", "asks", "vector")
    return met.groupBy(*run, "i", "j").applyInArrow(_meet(threshold, kind), _EDGES).where("a <> b").distinct()


def _compare(threshold: float, kind: str):
    """Of one block pair: for each row of the rest, the weight of its links with
    the members; for each member of the core, the weight of its links with the rest."""

    def compare(table: pa.Table) -> pa.Table:
        rest = table.column("asks").to_numpy().astype(bool)
        x, ids, weight = _matrix(table.column("vector").combine_chunks(), kind), table.column("rep").to_numpy(), table.column("n").to_numpy()
        core = table.column("core").to_numpy().astype(bool)[~rest]
        asked, answered = np.zeros(int(rest.sum()), np.int64), np.zeros(int((~rest).sum()), np.int64)
        members, own = x[~rest].T, np.flatnonzero(rest)
        for lo in range(0, len(own), TILE):  # one tile of the product at a time
            tile = own[lo : lo + TILE]
            close = (x[tile] @ members >= threshold) & (ids[tile][:, None] != ids[~rest][None, :])
            asked[lo : lo + TILE] = close @ weight[~rest]
            answered += weight[tile] @ close
        return pa.table({"rep": pa.array(np.concatenate([ids[rest], ids[~rest][core]])), "links": pa.array(np.concatenate([asked, answered[core]]).astype(np.int64))})

    return compare


def _link_counts(members: DataFrame, threshold: float, kind: str) -> DataFrame:
    """members: (component, rep, n, vector).  Returns (rep, links): the number of
    vectors linked with rep that are not equal to it, each copy counted."""
    pivot = members.groupBy("component").agg(F.min_by("vector", "rep").alias("pivot"), F.count(F.lit(1)).alias("size"))
    half = math.cos(math.acos(threshold) / 2 - 1e-9)

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            pairs = zip(part.column(3).to_pylist(), part.column(4).to_pylist())
            unit = [(np.frombuffer(v, kind).astype(np.float64), np.frombuffer(p, kind).astype(np.float64)) for v, p in pairs]
            core = [bool(v @ p >= half * np.sqrt((v @ v) * (p @ p))) for v, p in unit]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 1, 2, 3, 5)), pa.array(core, pa.bool_())], ["component", "rep", "n", "vector", "size", "core"])

    shape = "component long, rep long, n long, vector binary, size long, core boolean"
    judged = split_join(members, pivot, "component").select("component", "rep", "n", "vector", "pivot", "size").mapInArrow(near, shape)
    mass = judged.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("mass"), F.count_if(~F.col("core")).alias("rest"))
    judged = split_join(judged, mass, "component")
    inside = judged.where("core").select("rep", (F.col("mass") - F.col("n")).alias("links"))
    block = F.least(F.greatest(F.lit(128), F.ceil(F.col("size") / 64)), F.lit(4096))
    blocks = lambda count: F.greatest(F.lit(1), F.ceil(count / block)).cast("int")
    judged = judged.where("rest > 0").withColumns({"asked": blocks(F.col("rest")), "answering": blocks(F.col("size"))})
    place = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    to_all = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    asks = judged.where("NOT core").withColumns({"i": F.pmod(place, F.col("asked")).cast("int"), "j": to_all(F.col("answering")), "asks": F.lit(True)})
    answers = judged.withColumns({"j": F.pmod(place, F.col("answering")).cast("int"), "i": to_all(F.col("asked")), "asks": F.lit(False)})
    pairs = asks.unionByName(answers).select("component", "i", "j", "rep", "n", "vector", "core", "asks")
    outside = pairs.groupBy("component", "i", "j").applyInArrow(_compare(threshold, kind), "rep long, links long")
    return inside.unionByName(outside).groupBy("rep").agg(F.sum("links").alias("links"))


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", miss: float = 1e-7) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of one label link where their cosine, in double precision, is at
    least ``threshold``.  n_links counts the other vectors linked directly,
    copies each; component_id is the smallest id reachable, kept says whether it
    is the vector itself.  Vectors that are null, empty, zero or hold null or
    non-finite components, null labels and null ids link with nothing: n_links
    0, component_id the own id, kept.  Vectors of different lengths don't link.
    Repeated rows link as copies.  An empty table gives an empty result; other
    columns are ignored.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("embedding"), vectors[label_col].cast("long").alias("label"))
    # single precision travels as such: half the bytes, and cosines are computed in double
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    valid = rows.where(usable)
    distinct = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    largest = valid.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    order = ["label", "dims", "pass", "key", "rep"]
    passes = passes_needed(largest, threshold, miss)
    shape = "label long, dims int, pass int, key long, rep long"
    keyed = distinct.select("label", "rep", "embedding").mapInArrow(_keyed(passes, kind), f"{shape}, vector binary")
    parts = shuffle_partitions(vectors.sparkSession)
    edges = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_windows(threshold, kind), _EDGES).distinct()
    placed = checkpoint(connected_components(edges).select(F.col("node").alias("rep"), "component"))

    packed = distinct.mapInArrow(_packed(kind), "rep long, n long, vector binary")
    keys = distinct.select("label", "rep", "embedding").mapInArrow(_keyed(passes, kind, vectors=False), shape)
    wide = checkpoint(_wide_runs(keys, packed, placed, leading_bits(largest), threshold, kind))
    placed = connected_components(wide.unionByName(placed.select(F.col("rep").alias("a"), F.col("component").alias("b")))).select(F.col("node").alias("rep"), "component")

    counts = _link_counts(split_join(packed, placed, "rep").select("component", "rep", "n", "vector"), threshold, kind)
    found = distinct.select("label", "embedding", "rep", "n").join(placed, "rep", "left").join(counts, "rep", "left")
    found = found.select("label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = split_join(valid, found, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _packed(kind: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            flat = part.column("embedding")
            offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False).astype(kind)
            packed = pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("n"), packed], ["rep", "n", "vector"])

    return run
