"""Registered queries that pass through stores, sinks and overlays, and of scans.

What they write lies below the shared checkpoint folder and is removed once its
rows have been counted or copied.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import caveats, patterns
from tessera.operators import symbols
from tessera.operators.lineage import cut, remove, shared_folder
from tessera.plans.registry import query
from tessera.sources import catalog, store
from tessera.sources.adapters import files, snapshot_now, table
from tessera.sources.catalog import Scope
from tessera.streaming.changes import Overlay

FILES = """f AS (
    SELECT source || '/' || lang || '/doc' || doc_id || '.txt' AS path, lang AS language, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS hash, text AS content, doc_id FROM documents
)"""


@contextmanager
def passing_folder(spark: SparkSession, name: str) -> Iterator[str]:
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        remove(spark, folder)


# -- scans


@query(f"WITH {FILES} SELECT path, 'scan' AS stage, CASE WHEN doc_id % 9 = 0 THEN 'binary' ELSE 'too_large' END AS reason FROM f WHERE doc_id % 9 = 0 OR size > 4000")
def skip_log(spark: SparkSession, d: str) -> DataFrame:
    """Every ninth document with a zero byte in it."""
    raw = F.when(F.col("doc_id") % 9 == 0, F.concat(F.col("content").cast("binary"), F.unhex(F.lit("00")), F.lit("x").cast("binary"))).otherwise(F.col("content").cast("binary"))
    head = F.when(F.col("doc_id") % 9 == 0, F.concat(F.unhex(F.lit("6100")), raw)).otherwise(raw)
    scan = files(spark, d).select("path", F.when(catalog.looks_binary(head), "binary").when(F.col("size") > 4000, "too_large").alias("skip_reason"))
    return catalog.skipped(scan)


@query(f"WITH {FILES} SELECT path, language FROM f WHERE doc_id % 10 = 0 AND language = 'en'")
def changed_scope(spark: SparkSession, d: str) -> DataFrame:
    base = files(spark, d)
    changed = base.where("doc_id % 10 = 0").select("path").unionByName(spark.createDataFrame([("gone",)], "path string"))
    return Scope(languages=("en",), changed_only=True).apply(base, changed).select("path", "language")


_ASKED = [("files", "**", None), ("glob", "src/*.py", "glob"), ("find", "class", "literal"), ("find", "needle", "literal"), ("grep", ".*", "regex"), ("find", "x", "literal"), ("grep", "a.*", "regex")]


@query(
    """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'broad_path_pattern' WHEN 2 THEN 'broad_literal_pattern' WHEN 4 THEN 'broad_regex_pattern' WHEN 5 THEN 'broad_literal_pattern' END AS reason FROM part"""
)
def broad_patterns(spark: SparkSession, d: str) -> DataFrame:
    reasons = F.array(*(F.lit(patterns.broad_reason(*asked)) for asked in _ASKED))
    return table(spark, d, "part").select("p_partkey", F.element_at(reasons, (F.col("p_partkey") % 7 + 1).cast("int")).alias("reason"))


@query(
    """SELECT o_orderkey, c.code, CASE WHEN c.code = 'read_failed' THEN 'error' WHEN c.code = 'parser_fact' THEN 'info' ELSE 'warning' END AS severity,
       CASE c.code WHEN 'read_failed' THEN 'verify_file_exists_and_is_readable' WHEN 'parser_fact' THEN 'verify_with_read_before_editing' ELSE 'refine_query_or_accept_absence_is_not_proof' END AS next_action
    FROM orders JOIN (SELECT unnest([0, 1, 2]) AS k, unnest(['no_match', 'read_failed', 'parser_fact']) AS code) c ON o_orderkey % 4 = c.k"""
)
def caveat_contract(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array(*map(F.lit, ["no_match", "read_failed", "parser_fact", "unheard_of"]))
    rows = table(spark, d, "orders").select("o_orderkey", F.element_at(codes, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("code"))
    return rows.join(caveats.caveat_table(spark), "code").select("o_orderkey", "code", "severity", "next_action")


@query("SELECT 'k' || o_custkey AS symbol_key, o_orderkey AS line, c_mktsegment AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 2 = 0")
def occurrence_symbols(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string")).alias("symbol_key")
    occurrences = table(spark, d, "orders").select(key("o_custkey"), F.col("o_orderkey").alias("line"))
    known = table(spark, d, "customer").where("c_custkey % 2 = 0").select(key("c_custkey"), F.col("c_mktsegment").alias("name"))
    return symbols.occurrence_rows(occurrences, known)


# -- stores and sinks


@query(f"WITH {FILES}, s AS (SELECT unnest(['one', 'two']) AS snapshot_id) SELECT snapshot_id, count(*) AS rows FROM f, s WHERE snapshot_id = 'two' OR doc_id % 2 = 0 GROUP BY 1")
def snapshot_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots, one of them written again with fewer files."""
    catalog_rows = files(spark, d).select("path", "language", "size", "hash", "doc_id")
    with passing_folder(spark, "snapshots") as folder:
        tables = store.SnapshotStore(spark, folder)
        for name in ("one", "two"):
            tables.write("catalog", name, catalog_rows, ["path"])
        tables.write("catalog", "one", catalog_rows.where("doc_id % 2 = 0"), ["path"])
        return cut(tables.snapshots())


@query(f"WITH {FILES} SELECT path, hash FROM f")
def exported_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Proofs written, exported, checked against the manifest and taken in elsewhere."""
    with passing_folder(spark, "export") as folder:
        here, there = store.SnapshotStore(spark, f"{folder}/a"), store.SnapshotStore(spark, f"{folder}/b")
        here.write("proofs", "one", files(spark, d).select("path", "hash"))
        store.export_snapshot(here, "one", f"{folder}/export", ["proofs"])
        store.import_snapshot(there, "two", f"{folder}/export")
        return cut(there.read("proofs", "two").select("path", "hash"))


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'even' END AS note FROM nation")
def json_sink(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, "even").alias("note"))
    with passing_folder(spark, "json") as folder:
        store.write_json(rows, folder)
        return cut(spark.read.schema(rows.schema).json(folder))


@query(
    f"""WITH {FILES}, now AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN sha256(content || ' edited') ELSE hash END AS hash FROM f WHERE doc_id % 7 <> 0 UNION ALL SELECT 'bench/item' || item_id || '.txt', sha256(text) FROM benchmark)
    SELECT coalesce(f.path, now.path) AS path, CASE WHEN f.path IS NULL THEN 'added' WHEN now.path IS NULL THEN 'deleted' ELSE 'dirty' END AS status FROM f FULL JOIN now ON now.path = f.path WHERE f.hash IS DISTINCT FROM now.hash"""
)
def overlay_state(spark: SparkSession, d: str) -> DataFrame:
    """The overlay after it was filled, cleared and filled again."""
    stored, current = files(spark, d).select("path", "hash"), snapshot_now(spark, d)
    with passing_folder(spark, "overlay") as folder:
        overlay = Overlay(folder)
        overlay.replace(stored, stored)
        overlay.clear(spark)
        overlay.replace(stored, current)
        return cut(overlay.read(spark).select("path", "status"))
