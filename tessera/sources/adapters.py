"""Canonical relations built from the star-schema and corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import search, symbols
from tessera.plans.inputs import InputPlan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path() -> Column:
    return F.format_string("%s/%s/doc%d.txt", "source", "lang", "doc_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, language, size, mtime_ms, mode, hash, content."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        document_path().alias("path"),
        F.col("lang").alias("language"),
        F.octet_length("text").cast("long").alias("size"),
        F.col("doc_id").alias("mtime_ms"),
        F.lit(0o644).cast("long").alias("mode"),
        F.sha2("text", 256).alias("hash"),
        F.col("text").alias("content"),
        "doc_id",
    )


def snapshot_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree later: every seventh document gone, every fifth edited, the
    benchmark items new."""
    base = files(spark, sf_dir).where("doc_id % 7 <> 0")
    edited = F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit(" edited"))).otherwise(F.col("content"))
    now = base.select("path", "language", edited.alias("content"), F.when(F.col("doc_id") % 5 == 0, F.col("mtime_ms") + 1).otherwise(F.col("mtime_ms")).alias("mtime_ms"))
    new = table(spark, sf_dir, "benchmark").select(F.format_string("bench/item%d.txt", "item_id").alias("path"), F.lit("text").alias("language"), F.col("text").alias("content"), F.col("item_id").alias("mtime_ms"))
    return now.unionByName(new).select("path", "language", F.octet_length("content").cast("long").alias("size"), "mtime_ms", F.lit(0o644).cast("long").alias("mode"), F.sha2("content", 256).alias("hash"), "content")


def occurrences(spark: SparkSession, sf_dir: str, plan: InputPlan | None = None, contains: bool = False) -> DataFrame:
    """Identifiers of documents as occurrences; ``plan`` restricts the names, and
    is applied before definitions are found, which a name decides by itself."""
    if plan is None:
        return symbols.tokens_as_occurrences(search.tokens(files(spark, sf_dir)))
    found = search.tokens(files(spark, sf_dir), plan.parts)
    return symbols.tokens_as_occurrences(found.where(plan.matched_kind([F.col("name")], contains=contains).isNotNull()))


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file changes: the user is the file, the type the kind of change."""
    kinds = {"signup": "create", "click": "modify", "purchase": "rename", "error": "remove", "view": "metadata"}
    kind = F.element_at(F.create_map(*[F.lit(v) for item in kinds.items() for v in item]), F.col("event_type"))
    path = F.concat(F.lit("src/u"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(path.alias("path"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), F.when(kind == "rename", F.concat(path, F.lit(".old"))).alias("previous_path"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call graph of the star schema: parts call suppliers, those their
    nation, nations their region, and regions their nations (a cycle)."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    li = table(spark, sf_dir, "lineitem").select(name("p", "l_partkey").alias("caller_id"), name("s", "l_suppkey").alias("callee_id"), F.lit("lineitem").alias("file_path"), F.col("l_orderkey").alias("call_line"), F.col("l_linenumber").cast("long").alias("call_column"))
    su = table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("caller_id"), name("n", "s_nationkey").alias("callee_id"), F.lit("supplier").alias("file_path"), F.col("s_suppkey").alias("call_line"), F.lit(1).cast("long").alias("call_column"))
    na = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), name("n", "n_nationkey").alias("n"), name("r", "n_regionkey").alias("r"))
    up = na.select(F.col("n").alias("caller_id"), F.col("r").alias("callee_id"), F.lit("nation").alias("file_path"), F.col("k").alias("call_line"), F.lit(1).cast("long").alias("call_column"))
    down = na.select(F.col("r").alias("caller_id"), F.col("n").alias("callee_id"), F.lit("region").alias("file_path"), F.col("k").alias("call_line"), F.lit(2).cast("long").alias("call_column"))
    return li.unionByName(su).unionByName(up).unionByName(down)

