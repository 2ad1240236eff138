"""Small cases of the operators that need source code or files."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, patterns
from tessera.operators import config, events, graph, parser, results, routes, scheduler, search
from tessera.plans.inputs import Coordinate, InputPlan, qualified_tail, remove_signature, style_key
from tessera.plans.verbs import Engine
from tessera.sources import catalog, occurrences, store
from tessera.sources.catalog import Scope


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


FILES = "path string, language string, content string"


@pytest.fixture(scope="module")
def code(spark):
    rows = [
        ("src/a.py", "python", "import os\nfrom x.y import z\n\nclass Shop:\n    def sell(self, n):\n        return price(n)\n\ndef price(n):\n    # call(1)\n    return 'call(2)'\n"),
        ("src/B.java", "java", 'package p;\nimport java.util.List;\n@RestController\n@RequestMapping("/api")\npublic class B {\n  @GetMapping("/one")\n  public String one(int a) { return two(a); }\n  private String two(int a) { return "x"; }\n}\n'),
        ("src/m.rs", "rust", "use std::fmt;\npub struct P { x: i32 }\nfn caller() { callee(); }\nfn callee() {}\n"),
        ("src/m.go", "go", 'package m\nfunc Run() { work() }\nfunc work() {}\nfunc r(e *gin.Engine) { e.GET("/ping", ping) }\n'),
        ("src/t.ts", "typescript", "export const add = (a: number) => a + 1;\nfunction run() { add(2); }\napp.get('/x', run);\n"),
        ("app.py", "python", "app = FastAPI()\n@app.get('/items')\nasync def items():\n    return []\n"),
        ("config/routes.rb", "ruby", "root to: 'home#index'\nget '/a', to: 'a#show'\nresources :books\n"),
    ]
    return frame(spark, rows, FILES).cache()


def test_patterns():
    assert patterns.glob_regex("*.rs") == "^(?s:.*\\.rs)$"
    assert patterns.broad_reason("find", "class") == "broad_literal_pattern"
    assert patterns.broad_reason("glob", "**/*") == "broad_path_pattern"
    assert patterns.broad_reason("find", "needle") is None
    for bad in ("(?=x)", "(?<!x)y", r"(a)\1"):
        with pytest.raises(ValueError):
            patterns.compile_pattern(bad, "regex")
    assert patterns.compile_pattern("ab").prefilter is None
    assert patterns.compile_pattern("abc").prefilter == "abc"


def test_wildcard_is_unanchored_and_glob_is_anchored(spark):
    df = frame(spark, [("a/b/c.rs",), ("x.rs.txt",), ("c.rs",)], "path string")
    hit = lambda p, m: {r.path for r in df.where(patterns.compile_pattern(p, m, path=True).matches(F.col("path"))).collect()}
    assert hit("b*rs", "wildcard") == {"a/b/c.rs"}
    assert hit(".rs", "wildcard") == {"a/b/c.rs", "x.rs.txt", "c.rs"}
    assert hit("*.rs", "glob") == {"a/b/c.rs", "c.rs"}
    assert hit("**/c.rs", "glob") == {"a/b/c.rs", "c.rs"}
    assert hit("{a/b,z}/?.rs", "glob") == {"a/b/c.rs"}


def test_paths(spark):
    df = frame(spark, [(".env",), ("a/Gemfile",), ("a/x.TSX",), ("node_modules/y.ts",), ("Makefile",)], "path string")
    got = {r.path: r for r in df.select("path", paths.extension(F.col("path")).alias("e"), paths.language_of(F.col("path")).alias("l"), paths.is_skipped(F.col("path")).alias("s"), paths.parent(F.col("path")).alias("d")).collect()}
    assert got[".env"].e == "" and got["a/Gemfile"].l == "ruby" and got["a/x.TSX"].l == "text"
    assert got["node_modules/y.ts"].s and not got["Makefile"].s and got["Makefile"].d == "."


def test_input_plan():
    assert style_key("getHTTPUser-name_2B") == "get_httpuser_name_2_b"
    assert remove_signature("a.b(int)") == "a.b" and qualified_tail("a::B#c") == "c"
    plan = InputPlan(" Shop.sell(int) ")
    assert [k for k, _ in plan.variants][:5] == ["raw", "trimmed", "signature_base", "qualified_tail", "signature_tail"]
    assert len(plan.variants) <= 16
    assert Coordinate.parse("a/b.py:3#x") == Coordinate("a/b.py", 3, "x") and Coordinate.parse("a.py") is None
    assert InputPlan("x", strict=True).variants == [("raw", "x")]


def test_parser_symbols_calls_and_imports(spark, code):
    facts = parser.extract_facts(code).collect()
    symbols = {(f.path, f.symbol_kind, f.name, f.container) for f in facts if f.kind == "symbol"}
    assert {("src/a.py", "class", "Shop", None), ("src/a.py", "method", "sell", "Shop"), ("src/a.py", "function", "price", None)} <= symbols
    assert {("src/B.java", "class", "B", None), ("src/B.java", "method", "one", "B"), ("src/B.java", "method", "two", "B")} <= symbols
    assert {("src/m.rs", "struct", "P", None), ("src/m.go", "function", "Run", None), ("src/t.ts", "function", "add", None)} <= symbols
    calls = {(f.path, f.enclosing, f.target) for f in facts if f.kind == "call"}
    assert ("src/a.py", "sell", "price") in calls and ("src/m.rs", "caller", "callee") in calls
    assert not any(t == "call" for _, _, t in calls)  # in a comment and in a string
    assert {("src/a.py", "os"), ("src/a.py", "x.y"), ("src/B.java", "java.util.List")} <= {(f.path, f.name) for f in facts if f.kind == "import"}
    linked = parser.file_calls(parser.extract_facts(code)).where("target = 'two'").collect()
    assert [r.def_line for r in linked] == [8]


def test_calls_and_callers_are_inverse(spark, code):
    engine = Engine(code)
    assert {r.target for r in engine.calls("caller").collect()} == {"callee"}
    assert {r.enclosing for r in engine.callers("callee").collect()} == {"caller"}


def test_routes(spark, code):
    found = {(r.framework, r.method, r.route, r.handler) for r in routes.source_routes(code).collect()}
    assert ("spring", "GET", "/api/one", "one") in found
    assert ("gin", "GET", "/ping", "ping") in found
    assert ("fastapi", "GET", "/items", "items") in found
    assert ("express", "GET", "/x", "run") in found
    assert ("rails", "GET", "/a", "a#show") in found and ("rails", "RESOURCE", "/books", "books#*") in found
    only = Engine(code).routes(methods=["get"], frameworks=["gin"]).collect()
    assert [r.route for r in only] == ["/ping"]


def test_config_facts_mask_and_survive_bad_syntax(spark):
    rows = [
        ("a.json", "json", json.dumps({"db": {"password": "hunter2", "host": "h"}})),
        ("b.toml", "toml", '[tool]\nname = "x"\n'),
        ("c.yml", "yaml", "jobs:\n  build:\n    steps:\n      - name: s\n        run: make\n"),
        ("m.xml", "xml", '<mapper namespace="n.M"><resultMap id="r"/><sql id="c"/><select id="q" resultMap="r"><include refid="c"/></select></mapper>'),
        ("bad.json", "json", "{secret"),
        ("bad.toml", "toml", "= ="),
    ]
    facts = config.structured_facts(frame(spark, rows, FILES)).collect()
    by = {(f.path, f.key_path): f for f in facts}
    assert by["a.json", "db.password"].value_preview == "<masked>" and by["a.json", "db.host"].value_preview == "h"
    assert by["b.toml", "tool.name"].value_preview == "x"
    assert {f.fact_kind for f in facts if f.path == "c.yml"} >= {"workflow_job", "workflow_step", "workflow_script"}
    assert {(f.fact_kind, f.key_path) for f in facts if f.path == "m.xml"} == {("mapper_namespace", "n.M"), ("mapper_result_map", "n.M.r"), ("mapper_sql_fragment", "n.M.c"), ("mapper_statement", "n.M.q"), ("mapper_reference", "n.M.r"), ("mapper_reference", "n.M.c")}
    assert all("hunter2" not in str(f) and "{secret" not in str(f) for f in facts)
    assert {f.caveat for f in facts if f.path.startswith("bad")} == {"parse_failed"}


def test_line_based_config(spark):
    files = frame(spark, [("x.ini", "text", "top=1\n[s]\n; no\nk = v\n[t]\nk: w"), ("Makefile", "text", "all: a\n\tcc x\nV := 1\n"), ("Dockerfile", "text", "FROM a\n# RUN no\nCMD run\n"), ("r.sh", "text", "#!/bin/sh\nbuild() {\n  make all\n}\nX=1\n")], FILES)
    assert {(r.key_path, r.value) for r in config.ini_facts(files.where("path = 'x.ini'")).collect()} == {("top", "1"), ("s.k", "v"), ("t.k", "w")}
    assert [(r.target, r.recipe) for r in config.make_facts(files.where("path = 'Makefile'")).orderBy("line").collect()] == [("all", None), ("all", "cc x")]
    assert [(r.instruction, r.is_entrypoint) for r in config.dockerfile_facts(files.where("path = 'Dockerfile'")).orderBy("line").collect()] == [("FROM", False), ("CMD", True)]
    assert {(r.fact_kind, r.name) for r in config.shell_facts(files.where("path = 'r.sh'")).collect()} == {("shell_entrypoint", "/bin/sh"), ("shell_function", "build"), ("shell_command", "make")}


def test_match_across_lines_equals_python(spark):
    df = frame(spark, [("a", "text", "one\ntwo one\ntwo")], FILES)
    got = search.find_matches(df, patterns.compile_pattern("one\\ntwo", "regex")).orderBy("line").collect()
    assert [(r.line, r.column, r.end_line, r.end_column) for r in got] == [(1, 1, 2, 4), (2, 5, 3, 4)]


@pytest.mark.parametrize(
    "regex,want",
    [
        (r"\w+", [(1, 1, "naïve"), (1, 7, "été"), (2, 1, "import"), (2, 8, "y"), (3, 1, "n9"), (3, 4, "import")]),
        (r"y\W+n", [(2, 8, "y\nn")]),
        (r"y\sn", [(2, 8, "y\nn")]),
        (r"^import", []),
        (r"^na.ve", [(1, 1, "naïve")]),
        (r"(?m)^import", [(2, 1, "import")]),
        (r"import$", [(3, 4, "import")]),
        (r"(?m)y$", [(2, 8, "y")]),
        (r"é[^x]+y", [(1, 7, "été\nimport y")]),
        (r"[[:digit:]]+", [(3, 2, "9")]),
        (r"t.i", []),
        (r"(?s)é.i", [(1, 9, "é\ni")]),
        (r"x*", []),
    ],
)
def test_regex_dialect(spark, regex, want):
    df = frame(spark, [("a", "text", "naïve été\nimport y\nn9 import")], FILES)
    got = search.find_matches(df, patterns.compile_pattern(regex, "regex")).orderBy("line", "column").collect()
    assert [(r.line, r.column, r.match_text) for r in got] == want


def test_prefix_sums(spark):
    from tessera.functions.arrays import prefix_sums

    rows = [([],), (None,), ([3],), (list(range(1, 700)),), ([1] * 64,), ([2] * 65,)]
    got = frame(spark, rows, "v array<int>").select("v", prefix_sums(F.col("v")).alias("p")).collect()
    assert all(r.p == (None if r.v is None else [sum(r.v[:i]) for i in range(len(r.v))]) for r in got) and len(got) == len(rows)


def test_type_closure_has_no_depth_limit(spark):
    rows = [(f"t{i}", f"t{i + 1}") for i in range(40)] + [("t40", "t35"), ("a", "t3"), ("a", "t1"), ("a", "a")]
    got = {(r.subtype, r.supertype): r.depth for r in graph.type_closure(frame(spark, rows, "subtype string, supertype string")).collect()}
    want, edges = {}, {}
    for a, b in rows:
        edges.setdefault(a, set()).add(b)
    for start in edges:
        front, depth, seen = {start}, 0, {start}
        while front:
            depth += 1
            front = {n for f in front for n in edges.get(f, ())} - seen
            seen |= front
            want |= {(start, n): depth for n in front}
    assert got == want and max(got.values()) == 40


def test_prefilter_loses_nothing(spark):
    from tessera.functions.grams import explode_grams

    df = frame(spark, [("a", "text", "A Needle"), ("b", "text", "none"), ("c", "text", "nEEDLE x")], FILES)
    kept = search.prefiltered(df, explode_grams(df, fold_case=True), "Needle", True)
    assert {r.path for r in kept.collect()} == {"a", "c"}


def test_guard_and_cursor(spark):
    df = frame(spark, [(f"f{i:02}", "text", "class x") for i in range(16)], FILES)
    guarded = Engine(df).find("class")
    assert guarded.guard == "broad_literal_pattern" and guarded.rows.count() == 5 and guarded.next_cursor is None
    first = Engine(df).find("lass", limit=10)
    second = Engine(df).find("lass", limit=10, cursor=first.next_cursor)
    assert second.rows.count() == 6 and second.next_cursor is None
    assert first.facets.where("facet = 'language'").first()["count"] == 16
    with pytest.raises(ValueError):
        results.Cursor.decode(first.next_cursor, "other scope")
    with pytest.raises(ValueError):
        results.Cursor.decode("v2:x:1", "s")


def test_scope(spark):
    df = frame(spark, [("m/A.java", "java", ""), ("t/A.java", "java", ""), ("m/A.kt", "kotlin", "")], FILES)
    assert [r.path for r in Scope(directories=("m",), extensions=("java",)).apply(df).collect()] == ["m/A.java"]
    changed = frame(spark, [("m/A.kt",)], "path string")
    assert [r.path for r in Scope(changed_only=True).apply(df, changed).collect()] == ["m/A.kt"]


def test_scan_tree(spark, tmp_path):
    for name, data in {"a/x.py": b"x = 1\n", "b.bin": b"a\0b", ".git/c": b"c", "_p/__init__.py": b"y = 2\n", "node_modules/d.js": b"d", "big.txt": b"z" * 200}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    scan = catalog.scan_tree(spark, str(tmp_path), max_bytes=100)
    got = {r.path: r.skip_reason for r in scan.collect()}
    assert got == {"a/x.py": None, "b.bin": "binary", "_p/__init__.py": None, "node_modules/d.js": "ignored", "big.txt": "too_large"}
    one = catalog.with_proofs(catalog.included(scan)).where("path = 'a/x.py'").first()
    assert one.language == "python" and one.line_offsets == [0, 6] and len(one.hash) == 64
    assert catalog.scan_summary(scan).first().included == 2 and catalog.skipped(scan).count() == 3


def test_workspace(tmp_path):
    assert catalog.Workspace.discover(str(tmp_path)).snapshot_id == "worktree:non-git"
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init")
    (tmp_path / "f").write_text("1")
    git("add", "f")
    git("commit", "-m", "x")
    assert catalog.Workspace.discover(str(tmp_path)).snapshot_id.startswith("commit:")
    (tmp_path / "f").write_text("2")
    assert catalog.Workspace.discover(str(tmp_path)).snapshot_id.startswith("worktree:")
    assert catalog.Workspace.discover(str(tmp_path)).staged_content("f") == b"1"


def test_git_status(spark):
    lines = frame(spark, [("R  old.py -> new.py",), (" M b",), ("?? c",), ("M  d",)], "value string")
    got = {r.path: (r.previous_path, r.staged, r.unstaged, r.untracked) for r in catalog.parse_git_status(lines).collect()}
    assert got == {"new.py": ("old.py", True, False, False), "b": (None, False, True, False), "c": (None, False, False, True), "d": (None, True, False, False)}


def test_store_replaces_one_snapshot(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    rows = frame(spark, [("a", "h1"), ("b", "h2")], "path string, hash string")
    s.write("proofs", "one", rows)
    s.write("proofs", "two", rows)
    s.write("proofs", "one", rows.limit(1), sort=["path"])
    assert s.read("proofs", "one").count() == 1 and s.read("proofs", "two").count() == 2
    store.export_snapshot(s, "two", str(tmp_path / "e"), ["proofs"])
    assert store.verify_export(spark, str(tmp_path / "e")) == []
    rows.limit(1).write.mode("overwrite").parquet(str(tmp_path / "e/proofs"))
    assert store.verify_export(spark, str(tmp_path / "e")) == ["proofs"]


def test_occurrence_import(spark, tmp_path):
    doc = {"documents": [{"relative_path": "a.rs", "language": "rust", "symbols": [{"symbol": "local 1", "kind": "function"}], "occurrences": [{"symbol": "local 1", "range": [0, 3, 9], "symbol_roles": 1}, {"symbol": "local 1", "range": [1, 12, 1, 18]}, {"symbol": "local 1", "range": [1]}]}]}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    found, mentions = occurrences.import_json(spark, str(tmp_path / "i.json"))
    assert [(r.start_line, r.start_column, r.end_line, r.end_column, r.role) for r in found.orderBy("start_line").collect()] == [(1, 4, 1, 10, "definition"), (2, 13, 2, 19, "reference")]
    assert mentions.first().symbol_key == "a.rs#local 1"


def test_hierarchy_cuts_cycles_and_caps_children(spark):
    edges = frame(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("b", "d"), ("a", "b")], "caller_id string, callee_id string")
    roots = frame(spark, [("a",)], "id string")
    assert {tuple(r.route) for r in graph.hierarchy(edges, roots, 3).collect()} == {("a", "b"), ("a", "b", "c"), ("a", "b", "d")}
    assert {tuple(r.route) for r in graph.hierarchy(edges, roots, 2, limit=1).collect()} == {("a", "b"), ("a", "b", "c")}
    with pytest.raises(ValueError):
        graph.hierarchy(edges, roots, 9)


@pytest.mark.parametrize("kinds,change", [(["create", "remove"], None), (["create", "modify"], "modified"), (["modify", "remove"], "modified"), (["modify", "create"], "modified"), (["remove", "create"], "deleted"), (["create", "metadata"], "added"), (["remove", "rename"], "renamed"), (["rename_from", "modify"], "renamed")])
def test_event_fold(spark, kinds, change):
    rows = [("p", i, k, "old" if k == "rename" else None) for i, k in enumerate(kinds)] + [("dist/x", 9, "create", None)]
    got = events.fold_events(frame(spark, rows, "path string, seq long, kind string, previous_path string")).collect()
    assert [r.change for r in got] == ([change] if change else [])


def test_synthetic_members(spark):
    a = frame(spark, [("C", "Data"), ("C", "Builder")], "owner string, annotation string")
    f = frame(spark, [("C", "name", "String", False), ("C", "on", "boolean", True)], "owner string, name string, type string, is_final boolean")
    got = {(r.name, r.arity) for r in parser.synthetic_members(a, f).collect()}
    assert got == {("getName", 0), ("isOn", 0), ("setName", 1), ("<init>", 1), ("builder", 0)}


def test_saved_queries(tmp_path):
    saved = scheduler.SavedQueries(str(tmp_path))
    saved.save("q", "find", {"text": "x"}, "commit:1", "v1:a:5")
    assert saved.list() == ["q"] and saved.replay("q", "commit:1") == ("find", {"text": "x"}, "v1:a:5")
    assert saved.replay("q", "commit:2")[2] is None and saved.delete("q") and not saved.delete("q")
    with pytest.raises(ValueError):
        saved.show("../x")


def test_code_excerpts(spark, code):
    hits = parser.extract_facts(code).where("name = 'price' AND kind = 'symbol'").select("path", "start_line", "end_line")
    assert parser.code_excerpts(hits, code).first().code.startswith("def price(n):")


def test_defs_rank_precise_first(spark, code):
    occ = frame(spark, [("k", "src/m.rs", 1, 1, 1, 6, "definition", "python"), ("k", "out/of/scope.py", 1, 1, 1, 6, "definition", "python")], "symbol_key string, path string, start_line int, start_column int, end_line int, end_column int, role string, language string")
    sym = frame(spark, [("k", "s", "price", "function", "python")], "symbol_key string, symbol string, name string, kind string, language string")
    got = Engine(code, occurrences=occ, symbol_table=sym).defs("Price").rows.collect()
    assert [(r.path, r.reliability) for r in got] == [("src/m.rs", "precise_fact"), ("src/a.py", "parser_fact")]
    assert Engine(code).refs("price").rows.count() == 0


def test_caveats(spark):
    from tessera.functions.caveats import caveat_table

    got = {r.code: r for r in caveat_table(spark).collect()}
    assert len(got) == 41 and got["no_match"].severity == "warning" and got["read_failed"].category == "error" and got["parser_fact"].severity == "info"


def test_utf16_offsets_of_wide_characters(spark):
    from tessera.functions.symbolstrings import utf16_to_utf8

    df = frame(spark, [("aé🙂b", 0), ("aé🙂b", 2), ("aé🙂b", 4), ("aé🙂b", 5)], "t string, n int")
    assert [r.b for r in df.select(utf16_to_utf8(F.col("t"), F.col("n")).alias("b")).collect()] == [0, 3, 7, 8]


def test_index_life(spark, tmp_path):
    from tessera.plans.index import Index

    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("needle = 1\n")
    (tree / "b.py").write_text("other = 1\n")
    index = Index(spark, store.SnapshotStore(spark, str(tmp_path / "store")), str(tree))
    snapshot = index.build()
    assert index.verify(snapshot) == 0 and not index.update(snapshot)
    (tree / "b.py").write_text("Needle = 2\n")
    (tree / "c.py").write_text("needle = 3\n")
    spark.catalog.clearCache()
    assert index.verify(snapshot) == 6
    files = index.engine(snapshot)
    assert {r.path for r in files.find("needle").rows.collect()} == {"a.py", "b.py", "c.py"}
    assert {r.path: r.source for r in files.files.collect()} == {"a.py": "index", "b.py": "overlay", "c.py": "overlay"}
    assert index.update(snapshot) and index.verify(snapshot) == 0
