"""Sources, stores and verbs that have no table of the driver's to run over."""

import json
import re
import struct
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import results, scheduler
from tessera.plans.index import Index
from tessera.plans.verbs import Engine
from tessera.sources import catalog, classfile, scip_wire, store
from tessera.streaming.changes import Overlay

FILES = "path string, language string, content string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- ignore files


@pytest.mark.parametrize(
    "text,ignored,kept",
    [
        ("*.log\n!keep.log", ["a.log", "d/b.log"], ["keep.log", "d/keep.log", "a.txt"]),
        ("/top.txt\nsub/x", ["top.txt", "sub/x", "sub/x/y"], ["d/top.txt", "d/sub/x"]),
        ("out/\n# a comment\n\n", ["out/a", "d/out/b"], ["out", "d/out.txt"]),
        ("**/gen/*.py\ndocs/**", ["gen/a.py", "x/y/gen/b.py", "docs/a/b"], ["gen/a.txt", "docs"]),
        ("f?o[0-9].c", ["fxo1.c", "d/fao9.c"], ["fo1.c", "fxoa.c", "f/o1.c"]),
    ],
)
def test_ignore_files(spark, text, ignored, kept):
    for above in ("", "pkg/sub"):
        place = f"{above}/" if above else ""
        df = frame(spark, [(place + p,) for p in ignored + kept] + [("elsewhere/a.log",)] * bool(above), "path string")
        got = {r.path for r in df.where(paths.is_ignored(F.col("path"), [(above, text)])).collect()}
        assert got == {place + p for p in ignored}


def test_deeper_ignore_files_decide_later(spark):
    df = frame(spark, [("a.tmp",), ("d/a.tmp",), ("d/b.tmp",)], "path string")
    got = {r.path for r in df.where(paths.is_ignored(F.col("path"), [("d", "!a.tmp"), ("", "*.tmp")])).collect()}
    assert got == {"a.tmp", "d/b.tmp"}


def test_scan_honours_ignore_files_and_bounds_the_driver(spark, tmp_path, monkeypatch):
    for name, text in {".gitignore": "*.log\nbuild2/", "a.py": "x", "b.log": "x", "d/.ignore": "c.py", "d/c.py": "x", "d/e.py": "x", "build2/f.py": "x", "_g/h.py": "x", ".hid/i.py": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    scan = {r.path: r.skip_reason for r in catalog.scan_tree(spark, str(tmp_path)).collect()}
    assert scan == {"a.py": None, "b.log": "ignored", "d/c.py": "ignored", "d/e.py": None, "build2/f.py": "ignored", "_g/h.py": None}
    assert {r.path for r in catalog.list_tree(spark, str(tmp_path)).collect()} == {"a.py", "d/e.py", "_g/h.py"}
    assert {r.path for r in catalog.included(catalog.scan_tree(spark, str(tmp_path), no_ignore=True)).collect()} == {"a.py", "b.log", "d/c.py", "d/e.py", "build2/f.py", "_g/h.py"}
    assert {r.path for r in catalog.scan_tree(spark, str(tmp_path), only=["a.py", "_g/h.py"]).collect()} == {"a.py", "_g/h.py"}
    monkeypatch.setattr(catalog, "HIDDEN_FILES", 0)
    with pytest.raises(ValueError):
        catalog.scan_tree(spark, str(tmp_path))


# -- index files in wire format


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        value = value.encode() if isinstance(value, str) else value
        out += varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_wire_index(spark, tmp_path):
    packed = b"".join(map(varint, [0, 3, 9]))
    one = message((1, packed), (2, "local 1"), (3, 1))
    two = message((1, 300), (1, 12), (1, 301), (1, 18), (2, "pkg f()."))  # numbers one by one
    symbol = message((1, "local 1"), (3, "words"), (5, 17), (6, "shown"))
    document = message((4, "Rust"), (1, "a.rs"), (2, one), (2, two), (3, symbol), (3, message((1, "pkg f()."), (5, 9999))))
    (tmp_path / "i.scip").write_bytes(message((1, message((3, "root"))), (2, document), (3, symbol), (2, message((1, "empty.rs")))))
    found, mentions = scip_wire.import_wire(spark, str(tmp_path / "i.scip"))
    rows = found.orderBy("start_line").collect()
    assert [(r.symbol_key, r.start_line, r.start_column, r.end_line, r.end_column, r.role, r.language) for r in rows] == [("a.rs#local 1", 1, 4, 1, 10, "definition", "rust"), ("pkg f().", 301, 13, 302, 19, "reference", "rust")]
    assert {(m.symbol_key, m.name, m.kind) for m in mentions.collect()} == {("a.rs#local 1", "shown", "function"), ("pkg f().", "f", "symbol")}
    files = frame(spark, [("a.rs", "h1"), ("b.rs", "h2")], "path string, hash string")
    tables = scip_wire.occurrence_store(found, mentions, files)
    assert [r.path for r in tables["proofs"].collect()] == ["a.rs"] and {r.name_lc for r in tables["symbols"].collect()} == {"shown", "f"}
    for bad in (b"\x0a\xff", b"\xff" * 12, b"\x0b"):
        with pytest.raises((ValueError, IndexError)):
            list(scip_wire.documents_of(bad))


# -- class files


def class_bytes():
    pool = ["demo/Shop", "java/lang/Object", "demo/Sell", "n", "[J", "sell", "(Ljava/lang/String;[[IZ)Ljava/util/List;", "Code", "<clinit>", "()V"]
    constants = b"".join(b"\x01" + struct.pack(">H", len(t)) + t.encode() for t in pool)
    count = len(pool)
    constants += b"".join(b"\x07" + struct.pack(">H", n) for n in (1, 2, 3)) + b"\x05" + b"\0" * 8  # three classes and a long, which takes two places
    own, parent, sell = count + 1, count + 2, count + 3
    body = struct.pack(">HHHH", 0x21, own, parent, 1) + struct.pack(">H", sell)
    body += struct.pack(">H", 1) + struct.pack(">HHHH", 2, 4, 5, 0)
    code = struct.pack(">HI", 8, 4) + b"\0" * 4
    body += struct.pack(">H", 3) + struct.pack(">HHHH", 1, 6, 7, 1) + code + struct.pack(">HHHH", 8, 9, 10, 0) + struct.pack(">HHHH", 0x1001, 6, 10, 0) + struct.pack(">H", 0)
    return struct.pack(">IHHH", classfile.MAGIC, 0, 61, count + 6) + constants + body


def test_class_files_and_archives(spark, tmp_path):
    rows = list(classfile.symbols_of(class_bytes()))
    assert rows == [
        ("demo.Shop", "type", "demo.Shop", "class", None, 0x21), ("demo.Shop", "supertype", "java.lang.Object", "extends", None, 0), ("demo.Shop", "supertype", "demo.Sell", "implements", None, 0),
        ("demo.Shop", "field", "n", "long[]", None, 2), ("demo.Shop", "method", "sell", "java.util.List", ["java.lang.String", "int[][]", "boolean"], 1),
    ]
    (tmp_path / "Shop.class").write_bytes(class_bytes())
    with zipfile.ZipFile(tmp_path / "lib.jar", "w") as z:
        z.writestr("demo/Shop.class", class_bytes())
        z.writestr("META-INF/versions/9/demo/Shop.class", class_bytes())
        z.writestr("readme.txt", "x")
    (tmp_path / "bad.jar").write_bytes(b"no archive")
    (tmp_path / "short.class").write_bytes(class_bytes()[:60])
    got = classfile.read_classpath(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r.archive.rsplit("/", 1)[-1], []).append((r.entry, r.fact, r.name))
    assert len(by["lib.jar"]) == len(by["Shop.class"]) == 5 and by["lib.jar"][0] == ("demo/Shop.class", "type", "demo.Shop")
    assert by["bad.jar"] == [(None, "unreadable", None)] and by["short.class"] == [(None, "unreadable", None)]


def test_class_files_of_a_real_archive():
    import pyspark

    jar = next(Path(pyspark.__file__).parent.glob("jars/slf4j-api-*.jar"))
    rows = [row for _, data in classfile.class_files(jar.name, jar.read_bytes()) for row in classfile.symbols_of(data)]
    assert ("org.slf4j.Logger", "type", "org.slf4j.Logger", "interface") in {r[:4] for r in rows}
    assert ("org.slf4j.LoggerFactory", "method", "getLogger", "org.slf4j.Logger", ["java.lang.Class"]) in [r[:5] for r in rows]


# -- snapshots, overlay, index


def test_import_refuses_what_does_not_match(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    s.write("proofs", "one", frame(spark, [("a", "h1"), ("b", "h2")], "path string, hash string"))
    store.export_snapshot(s, "one", str(tmp_path / "e"), ["proofs"])
    other = store.SnapshotStore(spark, str(tmp_path / "o"))
    assert store.import_snapshot(other, "two", str(tmp_path / "e")) == ["proofs"] and other.read("proofs", "two").count() == 2
    for limits in ({"max_rows": 1}, {"max_bytes": 10}):
        with pytest.raises(ValueError):
            store.import_snapshot(other, "three", str(tmp_path / "e"), **limits)
    frame(spark, [("a", "forged")], "path string, hash string").write.mode("overwrite").parquet(str(tmp_path / "e/proofs"))
    with pytest.raises(ValueError, match="digests"):
        store.import_snapshot(other, "three", str(tmp_path / "e"))
    line = json.loads(next((tmp_path / "e/manifest").glob("*.json")).read_text())
    frame(spark, [("../x", line["rows"], line["digest"])], "table string, rows long, digest string").write.mode("overwrite").json(str(tmp_path / "e/manifest"))
    with pytest.raises(ValueError, match="unsafe"):
        store.import_snapshot(other, "three", str(tmp_path / "e"))
    assert not other.has("proofs", "three")


def test_overlay_keeps_whole_states(spark, tmp_path):
    schema = "path string, hash string"
    overlay = Overlay(str(tmp_path / "o"))
    assert overlay.read(spark).count() == 0
    before = frame(spark, [("a", "1"), ("b", "2")], schema)
    overlay.replace(before, frame(spark, [("a", "1"), ("b", "3")], schema))
    held = overlay.read(spark)
    overlay.replace(before, frame(spark, [("a", "1")], schema))
    assert [(r.path, r.status) for r in held.collect()] == [("b", "dirty")]  # a reader of the state before
    assert [(r.path, r.status) for r in overlay.read(spark).collect()] == [("b", "deleted")]
    (tmp_path / "o" / "99").mkdir()  # a state that was not written to its end
    assert overlay.read(spark).count() == 1
    overlay.clear(spark)
    assert overlay.read(spark).count() == 0


def test_index_reads_only_what_changed(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    for k in range(4):
        (tree / f"f{k}.py").write_text(f"def needle{k}(): pass\n")
    index = Index(spark, store.SnapshotStore(spark, str(tmp_path / "store")), str(tree))
    snapshot = index.build()
    assert all(index.doctor(snapshot).values()) and index.changed(snapshot).count() == 0
    (tree / "f0.py").write_text("changed = needle0 = 1\n")
    (tree / "f1.py").unlink()
    (tree / "g.py").write_text("needle = 5\n")
    assert {(r.path, r.status) for r in index.changed(snapshot).collect()} == {("f0.py", "touched"), ("f1.py", "deleted"), ("g.py", "added")}
    engine = index.engine(snapshot)
    assert {r.path for r in engine.find("needle").rows.collect()} == {"f0.py", "f2.py", "f3.py", "g.py"}
    assert {r.path: r.source for r in engine.files.collect()} == {"f0.py": "overlay", "f2.py": "index", "f3.py": "index", "g.py": "overlay"}
    plan = engine.find("needle2", allow_broad=True).rows._jdf.queryExecution().toString()
    assert re.search(r"gram#\d+ IN", plan)  # stored postings narrow the indexed files
    index.clean(snapshot)
    assert not any(index.doctor(snapshot).values())


def test_streams_keep_index_and_overlay_current(spark, tmp_path):
    from tessera.streaming.changes import refresh_index

    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("one = 1\n")
    index = Index(spark, store.SnapshotStore(spark, str(tmp_path / "store")), str(tree))
    snapshot = index.build()
    (tree / "b.py").write_text("two = 2\n")
    schema = "path string, hash string"
    frame(spark, [("target/x", "h")], schema).write.parquet(str(tmp_path / "events"))
    events = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "events"))
    refresh_index(events(), index, snapshot, str(tmp_path / "c1")).awaitTermination()
    assert index.facts(snapshot).catalog().count() == 1  # events of ignored directories only
    frame(spark, [("b.py", "h2")], schema).write.mode("append").parquet(str(tmp_path / "events"))
    refresh_index(events(), index, snapshot, str(tmp_path / "c1")).awaitTermination()
    assert index.facts(snapshot).catalog().count() == 2 and index.verify(snapshot) == 0
    overlay = Overlay(str(tmp_path / "o"))
    overlay.follow(events(), frame(spark, [("b.py", "h1"), ("target/x", "h")], schema), str(tmp_path / "c2")).awaitTermination()
    assert [(r.path, r.status) for r in overlay.read(spark).collect()] == [("b.py", "dirty")]


# -- verbs


@pytest.fixture(scope="module")
def engine(spark):
    rows = [("src/a.py", "python", "class Shop:\n    def sell(self):\n        return price(1)\n\ndef price(n):\n    return n\n"), ("src/b.py", "python", "def other():\n    return price(2)\n"), ("conf/app.json", "json", '{"price": {"list": 1}}')]
    edges = frame(spark, [(1, "a", "b"), (2, "b", "c"), (3, "d", "b")], "edge_id long, caller_id string, callee_id string")
    nodes = frame(spark, [(x, x) for x in "abcde"], "id string, display_name string")
    possible = frame(spark, [(2, "e")], "edge_id long, callee_id string")
    return Engine(frame(spark, rows, FILES).withColumns({"size": F.length("content").cast("long"), "hash": F.sha2("content", 256)}), edges=edges, nodes=nodes, possible_callees=possible)


def test_list_tree_and_state(spark, engine):
    assert {r.path for r in engine.list("src").collect()} == {"src/a.py", "src/b.py"}
    assert {r.path for r in engine.tree(1).collect()} == {"src", "conf"}
    lines = frame(spark, [(" M src/a.py",), ("?? x",)], "value string")
    assert engine.status(lines).first().changed == 2 and {r.path for r in engine.changed(lines).collect()} == {"src/a.py", "x"}


def test_definitions_with_code_and_config(engine):
    rows = engine.defs("price", include_code=True).rows.collect()
    assert [(r.path, r.producer) for r in rows] == [("src/a.py", "parser"), ("conf/app.json", "config")] or {r.producer for r in rows} == {"parser"}
    assert rows[0].code.startswith("def price(n):")
    assert {r.name for r in engine.symbols("lis").rows.collect()} == {"list"}


def test_freshness_gate_holds_precise_rows_back(spark, engine):
    from dataclasses import replace

    occurrences = frame(spark, [("k", "src/a.py", 5, 5, 5, 10, "definition", "python"), ("k", "src/b.py", 2, 12, 2, 17, "reference", "python")], "symbol_key string, path string, start_line int, start_column int, end_line int, end_column int, role string, language string")
    table = frame(spark, [("k", "s", "price", "function", "python")], "symbol_key string, symbol string, name string, kind string, language string")
    known = replace(engine, occurrences=occurrences, symbol_table=table)
    state = lambda s: frame(spark, [("r", "python", s)], "root_id string, language string, state string")
    assert [(r.path, r.def_line) for r in replace(known, manifests=state("fresh")).refs("price").rows.collect()] == [("src/b.py", 5)]
    assert replace(known, manifests=state("stale")).refs("price").rows.count() == 0
    assert {r.reliability for r in replace(known, manifests=state("stale")).defs("price", include_config=False).rows.collect()} == {"parser_fact"}


def test_hierarchy_directions_and_overrides(engine):
    routes = lambda **o: {(r.direction, *r.route) for r in engine.call_hierarchy("b", depth=1, **o).collect()}
    assert routes() == {("outgoing", "b", "c")}
    assert routes(direction="both") == {("outgoing", "b", "c"), ("incoming", "b", "a"), ("incoming", "b", "d")}
    assert routes(include_overrides=True) == {("outgoing", "b", "c"), ("outgoing", "b", "e")}
    with pytest.raises(ValueError):
        engine.call_hierarchy("b", direction="up")


def test_explore(engine):
    found = engine.explore("price")
    row = found.rows.first()
    assert found.guard is None and (row.path, row["name"]) == ("src/a.py", "price") and row.code.startswith("def price") and row.callers == ["other", "sell"]
    assert engine.explore("pric").guard == "explore_fallback: symbols"
    assert {r.path for r in engine.explore("b.py").rows.collect()} == {"src/b.py"}


def test_remote_snapshots_answer_for_missing_files(spark, engine):
    local = engine.files.where("path = 'src/a.py'").first()
    rows = [("one", "src/a.py", "python", local.hash, local.content), ("one", "far.py", "python", "h", "price = 3\n")]
    remote = frame(spark, rows, "snapshot_id string, path string, language string, hash string, content string")
    got = engine.remote_find("price", remote).rows.collect()
    assert [(r.path, r.snapshot_id, r.remote_label) for r in got] == [("far.py", "one", "unverified")]


def test_cursors_hold_for_their_results_only(spark):
    files = frame(spark, [(f"f{i:02}", "text", "lass x") for i in range(16)], FILES)
    first = Engine(files).find("lass", limit=10)
    assert Engine(files).find("lass", limit=10, cursor=first.next_cursor).rows.count() == 6
    more = files.unionByName(frame(spark, [("g", "text", "lass")], FILES))
    with pytest.raises(ValueError):
        Engine(more).find("lass", limit=10, cursor=first.next_cursor)


def test_saved_queries_run(tmp_path, spark):
    files = frame(spark, [("a", "text", "needle"), ("b", "text", "none")], FILES)
    saved = scheduler.SavedQueries(str(tmp_path))
    saved.save("q", "find", {"text": "needle"}, "commit:1")
    assert [r.path for r in saved.run("q", Engine(files), "commit:1").rows.collect()] == ["a"]
    saved.save("bad", "_scoped", {}, "commit:1")
    with pytest.raises(ValueError):
        saved.run("bad", Engine(files), "commit:1")


def test_byte_budget_sees_leading_rows_only(spark):
    rows = spark.range(100_000).withColumn("t", F.lit("x"))
    assert results.within_bytes(rows, ["id"], 100).count() == len(re.findall(r"\{", "".join(f'{{"id":{i},"t":"x"}}' for i in range(6))))
