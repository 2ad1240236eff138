"""Import of symbol occurrences from index documents in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import identifiers as ids

SCHEMA = """documents array<struct<
    relative_path:string, language:string,
    symbols:array<struct<symbol:string, display_name:string, kind:string>>,
    occurrences:array<struct<symbol:string, range:array<int>, symbol_roles:int>>>>"""


def range_columns(r: Column) -> list[Column]:
    """1-based start and end from 3 (one line) or 4 zero-based numbers."""
    three = F.size(r) == 3
    return [
        (r[0] + 1).cast("long").alias("start_line"),
        (r[1] + 1).cast("long").alias("start_column"),
        (F.when(three, r[0]).otherwise(F.get(r, F.lit(2))) + 1).cast("long").alias("end_line"),
        (F.when(three, F.get(r, F.lit(2))).otherwise(F.get(r, F.lit(3))) + 1).cast("long").alias("end_column"),
    ]


def short_range(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The inverse: 3 numbers within a line, else 4."""
    zero = [x - 1 for x in (a, b, c, d)]
    return F.when(a == c, F.array(zero[0], zero[1], zero[3])).otherwise(F.array(*zero))


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(occurrences, symbol mentions) of index files; ranges of other lengths are refused rows."""
    index = spark.read.schema(SCHEMA).option("multiLine", "true").json(path)
    return from_documents(index.select(F.explode("documents").alias("d")).select("d.*"))


def from_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = ids.document_symbol_key(F.col("o.symbol"), F.col("relative_path"))
    each = documents.select("relative_path", "language", F.explode("occurrences").alias("o")).where(F.size("o.range").isin(3, 4))
    occurrences = each.select(
        key.alias("symbol_key"),
        F.col("relative_path").alias("path"),
        "language",
        *range_columns(F.col("o.range")),
        F.when(ids.has_role(F.coalesce("o.symbol_roles", F.lit(0)), "definition"), "definition").otherwise("reference").alias("role"),
    )
    mentions = documents.select("relative_path", "language", F.posexplode("symbols").alias("n", "o")).select(
        key.alias("symbol_key"),
        F.concat_ws("#", "relative_path", F.lpad(F.col("n").cast("string"), 9, "0")).alias("position"),
        "o.symbol",
        F.coalesce("o.display_name", ids.display_name(F.col("o.symbol"))).alias("name"),
        "o.kind",
        "language",
    )
    return occurrences, mentions
