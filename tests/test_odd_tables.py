"""Queries on tables that the smallest folder doesn't have: large keys, ties, many alike."""

import duckdb

from tests.compare import rows, views
from tests.conftest import SMALL


def _against_sql(spark, folder, name):
    from tessera.plans import queries as q

    con = views(folder)
    con.execute("SET threads = 1")
    found, wanted = rows(q.QUERIES[name](spark, str(folder)).toPandas()), rows(con.sql(q.SQL[name]).df())
    assert len(found) > 0 and found == wanted


def test_roots_with_keys_beyond_a_million(spark, tmp_path):
    part = f"FROM '{SMALL}/part.parquet', (SELECT unnest([0, 999_900, 2_000_000]) AS s)"
    duckdb.sql(f"COPY (SELECT * REPLACE (p_partkey + s AS p_partkey) {part}) TO '{tmp_path}/part.parquet'")
    _against_sql(spark, tmp_path, "hierarchy_roots")


def test_upsert_takes_the_first_of_a_tie(spark, tmp_path):
    tied = "SELECT * REPLACE (1 AS l_partkey, 1 AS l_orderkey, l_linenumber % 3 AS l_linenumber, 0.0 AS l_tax, 0.0 AS l_discount, chr(65 + CAST(i % 26 AS INT)) AS l_returnflag) FROM (SELECT *, row_number() OVER () AS i"
    duckdb.sql(f"COPY ({tied} FROM '{SMALL}/lineitem.parquet' LIMIT 50)) TO '{tmp_path}/lineitem.parquet'")
    duckdb.sql(f"COPY (SELECT * EXCLUDE (i) FROM '{tmp_path}/lineitem.parquet') TO '{tmp_path}/x' (FORMAT parquet)")
    (tmp_path / "x").rename(tmp_path / "lineitem.parquet")
    _against_sql(spark, tmp_path, "symbol_upsert")


def test_calls_and_methods_that_are_alike_meet_once(spark):
    """900 million pairs of a call and a candidate, of one kind and one class."""
    from tessera.operators import graph

    calls = spark.range(30_000).selectExpr("id AS call_id", "'B' AS receiver_type", "'f' AS target_name", "1 AS arg_count", "array('C') AS arg_types")
    own = spark.range(30_000).selectExpr("concat('m', id) AS method_id", "'A' AS owner", "'f' AS name", "1 AS arity", "array('C') AS parameters")
    more = [("n1", "B", "g", 1, ["C"]), ("n2", "D", "g", 1, ["C"]), ("n3", "B", "h", 1, ["A"]), ("n3", "D", "h", 1, ["A"])]
    methods = own.unionByName(spark.createDataFrame(more, "method_id string, owner string, name string, arity int, parameters array<string>"))
    asked = [(-1, "B", "g", 1, ["C"]), (-2, "B", "h", 1, ["B"]), (-3, "B", "h", 1, ["C"]), (-4, "B", "none", 1, [None]), (-5, "B", "g", 1, [None]), (-5, "B", "g", 1, ["C"])]
    closure = spark.createDataFrame([("B", "A", 1), ("D", "B", 1), ("D", "A", 2)], "subtype string, supertype string, depth int")
    raw = calls.unionByName(spark.createDataFrame(asked, "call_id long, receiver_type string, target_name string, arg_count int, arg_types array<string>"))
    found = graph.resolve_calls(raw, methods, closure).collect()
    assert {tuple(r)[1:] for r in found if r.call_id >= 0} == {("ambiguous", None, 30_000)} and len(found) == 30_006
    few = {r.call_id: tuple(r)[1:] for r in found if r.call_id < 0}
    assert few == {-1: ("resolved", "n1", 1), -2: ("resolved", "n3", 1), -3: ("resolved", "n3", 1), -4: ("unresolved", None, 0), -5: ("resolved", "n1", 1)}
    over = graph.override_callees(spark.createDataFrame([(i, "n1") for i in range(5)] + [(9, None)], "call_id long, callee string"), methods, closure)
    assert sorted(map(tuple, over.collect())) == [(i, m) for i in range(5) for m in ("n1", "n2")]
