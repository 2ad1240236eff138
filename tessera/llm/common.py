"""Helpers that several operators share."""

from __future__ import annotations

import math
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder.  A session on one machine (a local
    master) without one gets a folder of its own; any other has to name one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[[^-\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that a file of a checkpoint holds at least, if the number of rows is known.
ROWS_A_FILE = 1 << 16


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.  Where a bound on
    its ``rows`` is known, few rows go to few files, however many partitions a
    shuffle has; many rows keep their partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        files = -(-rows // ROWS_A_FILE) or 1
        if files < shuffle_partitions(df.sparkSession):
            df = df.coalesce(files)
    return df.checkpoint(eager=True)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, under fixed names; whatever else
    the input holds (and whatever it is called) can't clash with results."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of text) of a DataFrame: two numbers that size blocks."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("b")).first()
    return int(row.n), int(row.b or 0)


#: Text that a task holds at once, at least.
CHUNK_BYTES = 4 << 20


def chunk_size(size: int) -> int:
    """Bytes of a chunk of a corpus of ``size`` bytes: its square root times 22.6
    or CHUNK_BYTES if that is more.  Where each chunk sends one row to each of as many buckets,
    there are at most size / 512 such rows, and chunks of 226 MB at 100 TB."""
    return max(CHUNK_BYTES, math.isqrt(512 * size))


def split_join(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose inputs both get a fresh exchange.

    A side that was just aggregated on the keys would otherwise keep its
    partitioning, and adaptive execution only splits a hot key when both inputs
    of a sort-merge join come straight from an exchange.  A further key that the
    others imply brings that about.  Nulls never match.
    """
    keys = [keys] if isinstance(keys, str) else keys
    part: Column = F.pmod(F.xxhash64(*keys), F.lit(8))
    return left.withColumn("__part", part).join(right.withColumn("__part", part), [*keys, "__part"], how).drop("__part")


def bounded_sample(rows: DataFrame, key: str, total: int, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hash of ``key``, of ``total`` rows.

    A bound on the hash that twice as many rows are expected to meet comes first,
    so what tasks hand on for the final order follows ``most`` and not the
    number of tasks."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    share = min(1.0, (2 * most + 100) / max(total, 1))
    return rows.where(place < F.lit(int(share * (1 << 40)))).orderBy(place, key).limit(most)


#: Partial sums of a map stage: ``part`` numbers the task, ``sums`` is a float64
#: vector as packed by pack_sums.
SUMS = "block int, part int, sums binary"
FAN_IN = 64


def pack_sums(values: np.ndarray) -> bytes:
    """Byte plane by byte plane: sums that are small whole numbers are mostly zero
    bytes, which vanish in the shuffle's compression."""
    return np.ascontiguousarray(values, np.float64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sums(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.float64).reshape(-1)


def _add(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")  # one order of additions, whatever came first
    total = 0.0
    for blob in table.column("sums"):
        total = total + unpack_sums(blob.as_py())
    return pa.table({"block": table.column("block")[:1], "part": pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int32()), "sums": pa.array([pack_sums(total)], pa.binary())})


def tree_summed(sums: DataFrame, parts: int) -> DataFrame:
    """Add up SUMS rows by block in rounds, FAN_IN partial sums to a task, so no
    task's work grows with the number of map tasks; one row a block is left."""
    while parts > 1:
        sums = sums.withColumn("into", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("block", "into").applyInArrow(lambda t: _add(t.drop_columns(["into"])), SUMS)
        parts = -(-parts // FAN_IN)
    return sums


def tree_sum(sums: DataFrame, parts: int) -> dict[int, np.ndarray]:
    """The rows of tree_summed, collected: their number and size are fixed."""
    return {row.block: unpack_sums(row.sums) for row in tree_summed(sums, parts).collect()}
