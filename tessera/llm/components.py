"""Connected components of a link table, wholly distributed.

Alternating large-star and small-star rounds: each node hands the smallest
neighbour to the others until every edge is (node, smallest node).  The number
of rounds grows with the logarithm of the graph's size; each round is a map-side
combined minimum and one join whose hot keys adaptive execution can split.  The
links of a small graph, which a checkpoint holds in one file, are followed in one
task instead: rounds cost the driver a plan of many stages each, whatever their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ROWS_A_FILE, checkpoint, split_join


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest, node) that connect what the links (a, b) connect; each
    node is named once."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        was, least = label, np.minimum(label[u], label[v])
        label = label.copy()
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        label = label[label]
        if np.array_equal(label, was):
            break
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def _at_once(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (u, v) of a small graph as (node, smallest node)."""
    links = pa.Table.from_batches(parts, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    least, node = forest(*(links.column(k).to_numpy() for k in (0, 1)))
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(least, pa.int64())], ["u", "v"])


def _descending(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _descending(split_join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = split_join(edges, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _descending(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link, component being the smallest
    node reachable.  Self-links, repeated links and links with a null end are
    harmless: they add no node.  An empty table gives an empty result."""
    edges = checkpoint(_descending(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).na.drop()))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = state(edges)
    small = was[0] <= ROWS_A_FILE
    if small and was[0]:
        edges = checkpoint(edges.coalesce(1).mapInArrow(_at_once, "u long, v long"), was[0])
    for _ in range(max_rounds):
        if small:
            break
        edges = checkpoint(_small_star(_large_star(edges)), 2 * was[0])
        now = state(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
