"""Registered queries of the extractors, over a source tree made from the supplier
table: supplier n gives one file, in the language numbered n % 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import config, java, parser, routes
from tessera.plans.registry import query
from tessera.sources.adapters import table

_SOURCES = [
    ("python", "py", "from fastapi import APIRouter\nrouter = APIRouter()\n\nclass Shop~:\n    def sell~(self, n):\n        return price~(n)  # call(x)\n\n@router.get('/items/~')\ndef price~(n):\n    return 'call(1)'\n"),
    ("java", "java", 'package shop;\nimport java.util.List;\n\n@RestController\n@RequestMapping("/api~")\npublic class Shop~ extends Base implements Sell {\n    private List<String> names;\n    @GetMapping("/one")\n    public String one(int a) { return two(a, "x"); }\n    String two(int a, String b) { names.add(b); return b; }\n}\n'),
    ("go", "go", 'package shop\n\nimport "fmt"\n\ntype Shop~ struct {}\n\nfunc Run~(r Router) {\n\tr.GET("/ping/~", ping~)\n\thttp.HandleFunc("/old", Old)\n}\n\nfunc ping~() { fmt.Println("x") }\n'),
    ("rust", "rs", "use std::fmt;\npub struct Shop~ { n: u32 }\nfn caller~() { callee~(1) }\nfn callee~(n: u32) {}\n"),
    ("typescript", "ts", "import { x } from './x';\nclass Shop~ {\n  sell(n: number) {\n    return add~(n);\n  }\n}\nfunction add~(n) { return n; }\napp.get('/ts/~', auth, add~);\n"),
    ("ruby", "rb", "require 'json'\nclass Shop~\n  def sell\n    price(1)\n  end\nend\nget '/rb/~', to: 'shops#show'\nresources :books~\n"),
    ("kotlin", "kt", "import a.b\nclass Shop~ {\n    fun sell(n: Int) { price(n) }\n}\n"),
    ("swift", "swift", 'import Vapor\nstruct Shop~ {\n    func sell() { price() }\n}\nlet v1 = app.grouped("v~")\nv1.get("list", use: list)\napp.post("make") { req in 1 }\n'),
]


def source_tree(spark: SparkSession, d: str, sources: list[tuple[str, str, str]] = _SOURCES) -> DataFrame:
    """Files (path, language, content), each text with its supplier's number for ~."""
    key = F.col("s_suppkey")
    pick = lambda n: F.element_at(F.array(*(F.lit(s[n]) for s in sources)), (key % len(sources) + 1).cast("int"))
    number = key.cast("string")
    path = F.concat(F.lit("src/s"), number, F.when(F.startswith(pick(1), F.lit("/")), pick(1)).otherwise(F.concat(F.lit("."), pick(1))))
    text = F.replace(pick(2), F.lit("~"), number)
    return table(spark, d, "supplier").select(path.alias("path"), pick(0).alias("language"), text.alias("content"))


def _rows(columns: str, rows: list[tuple[int, str]], languages: int = 8) -> str:
    """SQL: for each supplier the rows of its language; $ stands for its number."""
    parts = [f"SELECT {values.replace('$', chr(39) + ' || s_suppkey || ' + chr(39))} FROM supplier WHERE s_suppkey % {languages} = {n}" for n, values in rows]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS t({columns})"


@query(
    _rows(
        "path, symbol_kind, name, container",
        [
            (0, "'src/s$.py', 'class', 'Shop$', NULL"), (0, "'src/s$.py', 'method', 'sell$', 'Shop$'"), (0, "'src/s$.py', 'function', 'price$', NULL"),
            (1, "'src/s$.java', 'class', 'Shop$', NULL"), (1, "'src/s$.java', 'method', 'one', 'Shop$'"), (1, "'src/s$.java', 'method', 'two', 'Shop$'"),
            (2, "'src/s$.go', 'struct', 'Shop$', NULL"), (2, "'src/s$.go', 'function', 'Run$', NULL"), (2, "'src/s$.go', 'function', 'ping$', NULL"),
            (3, "'src/s$.rs', 'struct', 'Shop$', NULL"), (3, "'src/s$.rs', 'function', 'caller$', NULL"), (3, "'src/s$.rs', 'function', 'callee$', NULL"),
            (4, "'src/s$.ts', 'class', 'Shop$', NULL"), (4, "'src/s$.ts', 'method', 'sell', 'Shop$'"), (4, "'src/s$.ts', 'function', 'add$', NULL"),
            (5, "'src/s$.rb', 'class', 'Shop$', NULL"), (5, "'src/s$.rb', 'method', 'sell', 'Shop$'"),
            (6, "'src/s$.kt', 'class', 'Shop$', NULL"), (6, "'src/s$.kt', 'method', 'sell', 'Shop$'"),
            (7, "'src/s$.swift', 'struct', 'Shop$', NULL"), (7, "'src/s$.swift', 'method', 'sell', 'Shop$'"),
        ],
    )
)
def parser_symbols(spark: SparkSession, d: str) -> DataFrame:
    return parser.extract_facts(source_tree(spark, d)).where("kind = 'symbol'").select("path", "symbol_kind", "name", "container")


@query(_rows("path, name", [(0, "'src/s$.py', 'fastapi'"), (1, "'src/s$.java', 'java.util.List'"), (2, "'src/s$.go', 'fmt'"), (3, "'src/s$.rs', 'std::fmt'"), (4, "'src/s$.ts', './x'"), (5, "'src/s$.rb', 'json'"), (6, "'src/s$.kt', 'a.b'"), (7, "'src/s$.swift', 'Vapor'")]))
def parser_imports(spark: SparkSession, d: str) -> DataFrame:
    return parser.extract_facts(source_tree(spark, d)).where("kind = 'import'").select("path", "name")


@query(
    _rows(
        "path, enclosing, target, line, def_line",
        [(0, "'src/s$.py', 'sell$', 'price$', 6, 9"), (1, "'src/s$.java', 'one', 'two', 9, 10"), (3, "'src/s$.rs', 'caller$', 'callee$', 3, 4"), (4, "'src/s$.ts', 'sell', 'add$', 4, 7")],
    )
)
def calls_in_file(spark: SparkSession, d: str) -> DataFrame:
    """Calls that have their definition in the same file."""
    found = parser.file_calls(parser.extract_facts(source_tree(spark, d))).where("def_line IS NOT NULL")
    return found.select("path", "enclosing", "target", F.col("start_line").alias("line"), "def_line")


@query(
    _rows(
        "path, line, framework, method, route, handler, handler_kind",
        [
            (0, "'src/s$.py', 8, 'fastapi', 'GET', '/items/$', 'price$', 'function'"),
            (1, "'src/s$.java', 8, 'spring', 'GET', '/api$/one', 'one', 'method'"),
            (2, "'src/s$.go', 8, 'gin', 'GET', '/ping/$', 'ping$', 'function'"), (2, "'src/s$.go', 9, 'net/http', 'ANY', '/old', 'Old', 'function'"),
            (4, "'src/s$.ts', 8, 'express', 'GET', '/ts/$', 'add$', 'function'"),
            (5, "'src/s$.rb', 7, 'rails', 'GET', '/rb/$', 'shops#show', 'controller_action'"), (5, "'src/s$.rb', 8, 'rails', 'RESOURCE', '/books$', 'books$#*', 'controller'"),
            (7, "'src/s$.swift', 6, 'vapor', 'GET', '/v$/list', 'list', 'function'"), (7, "'src/s$.swift', 7, 'vapor', 'POST', '/make', '<inline>', 'function'"),
        ],
    )
)
def source_routes(spark: SparkSession, d: str) -> DataFrame:
    return routes.source_routes(source_tree(spark, d)).select("path", "line", "framework", "method", "route", "handler", "handler_kind")


_MORE_ROUTES = [
    ("python", "py", "fl = Flask(__name__)\n@fl.route('/r~', methods=['POST'])\ndef r~(): pass\nurlpatterns = [path('x~/', views.Shop~.as_view(), name='x'), re_path(r'^y$', y)]\nrouter.register(r'users~', UserViewSet)\n"),
    ("go", "go", 'package p\nfunc f() {\n\tr.Get("/c~", h.Do~)\n\tr.Method("PUT", "/m", put)\n\tm.HandleFunc("/g~", gor).Methods("DELETE")\n}\n'),
    ("typescript", "ts", "@Controller('cats~')\nclass A~ {\n  @Get(':id')\n  find(x) {}\n  @Post()\n  async make() {}\n}\nrouter.use('/all', (a) => { })\n"),
    ("java", "java", '@RequestMapping("/x")\npublic class B~ {\n    @RequestMapping(value = "/m~", method = RequestMethod.POST)\n    public String m(int x) { return ""; }\n    @DeleteMapping\n    public void gone() { }\n}\n'),
]


@query(
    _rows(
        "path, line, framework, method, route, handler",
        [
            (0, "'src/s$.py', 2, 'flask', 'ANY', '/r$', 'r$'"), (0, "'src/s$.py', 4, 'django', 'ANY', 'x$/', 'Shop$'"), (0, "'src/s$.py', 4, 'django', 'ANY', '^y' || chr(36), 'y'"), (0, "'src/s$.py', 5, 'django', 'VIEWSET', '/users$', 'UserViewSet'"),
            (1, "'src/s$.go', 3, 'chi', 'GET', '/c$', 'Do$'"), (1, "'src/s$.go', 4, 'chi', 'PUT', '/m', 'put'"), (1, "'src/s$.go', 5, 'gorilla', 'DELETE', '/g$', 'gor'"),
            (2, "'src/s$.ts', 3, 'nestjs', 'GET', '/cats$/:id', 'find'"), (2, "'src/s$.ts', 5, 'nestjs', 'POST', '/cats$', 'make'"), (2, "'src/s$.ts', 8, 'express', 'USE', '/all', '<inline>'"),
            (3, "'src/s$.java', 3, 'spring', 'POST', '/x/m$', 'm'"), (3, "'src/s$.java', 5, 'spring', 'DELETE', '/x', 'gone'"),
        ],
        4,
    )
)
def framework_routes(spark: SparkSession, d: str) -> DataFrame:
    return routes.source_routes(source_tree(spark, d, _MORE_ROUTES)).select("path", "line", "framework", "method", "route", "handler")


@query(
    _rows(
        "path, fact, owner, name, type, parameters, arguments, receiver_type",
        [
            (1, f"'src/s$.java', {row}")
            for row in (
                "'package', NULL, 'shop', NULL, NULL, NULL, NULL", "'import', NULL, 'java.util.List', NULL, NULL, NULL, NULL", "'type', NULL, 'Shop$', NULL, NULL, NULL, NULL",
                "'supertype', 'Shop$', 'Base', NULL, NULL, NULL, NULL", "'supertype', 'Shop$', 'Sell', NULL, NULL, NULL, NULL", "'field', 'Shop$', 'names', 'List', NULL, NULL, NULL",
                "'method', 'Shop$', 'one', 'String', 'int', NULL, NULL", "'method', 'Shop$', 'two', 'String', 'int,String', NULL, NULL",
                "'call', 'Shop$.one', 'two', NULL, NULL, 'int,String', 'Shop$'", "'call', 'Shop$.two', 'add', NULL, NULL, 'String', 'List'",
            )
        ],
    )
)
def java_facts(spark: SparkSession, d: str) -> DataFrame:
    found = java.extract_java(source_tree(spark, d))
    return found.select("path", "fact", "owner", "name", "type", F.array_join("parameters", ",").alias("parameters"), F.array_join("arguments", ",").alias("arguments"), "receiver_type")


@query(
    _rows("owner, name, arity, kind, overloads", [(1, "'Shop$', 'names', NULL, 'field', 1"), (1, "'Shop$', 'one', 1, 'method', 1"), (1, "'Shop$', 'two', 2, 'method', 1")])
)
def java_members(spark: SparkSession, d: str) -> DataFrame:
    return java.members(java.extract_java(source_tree(spark, d)))


@query(_rows("path, name, code, code_truncated", [(0, "'src/s$.py', 'price$', 'def price$(n):', true"), (3, "'src/s$.rs', 'callee$', 'fn callee$(n: u32) {}', false")]))
def code_excerpt(spark: SparkSession, d: str) -> DataFrame:
    tree = source_tree(spark, d)
    hits = parser.extract_facts(tree).where("kind = 'symbol' AND (name LIKE 'price%' OR name LIKE 'callee%')").select("path", "name", "start_line", "end_line")
    return parser.code_excerpts(hits, tree, max_lines=1).select("path", "name", "code", "code_truncated")


@query(
    """WITH f AS (SELECT 'C' || s_nationkey AS owner, 'item' || s_suppkey AS name, s_suppkey % 2 = 0 AS is_final FROM supplier), o AS (SELECT owner, count(*) AS n, count_if(is_final) AS finals FROM f GROUP BY 1)
    SELECT owner, 'getItem' || substr(name, 5) AS name, 0 AS arity, 'getter' AS origin FROM f UNION ALL SELECT owner, 'setItem' || substr(name, 5), 1, 'setter' FROM f WHERE NOT is_final
    UNION ALL SELECT owner, '<init>', CAST(finals AS INT), 'constructor' FROM o UNION ALL SELECT owner, 'builder', 0, 'builder' FROM o"""
)
def synthetic_members(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "supplier").select(F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("owner"), F.concat(F.lit("item"), F.col("s_suppkey").cast("string")).alias("name"), F.lit("String").alias("type"), (F.col("s_suppkey") % 2 == 0).alias("is_final"))
    annotations = fields.select("owner", F.explode(F.array(F.lit("Data"), F.lit("Builder"))).alias("annotation")).distinct()
    return parser.synthetic_members(annotations, fields)


# -- configuration

_CONFIGS = [
    ("json", "json", '{"db": {"host": "h~", "password": "p~"}, "list": [{"n": ~}]}'),
    ("yaml", "yml", "jobs:\n  build~:\n    steps:\n      - name: s~\n        run: make\nversion: ~\n"),
    ("toml", "toml", '[tool.x]\nname = "n~"\nnumber = ~\n'),
    ("xml", "xml", '<mapper namespace="n.M~"><resultMap id="r"/><sql id="c"/><select id="q~" resultMap="r"><include refid="c"/></select></mapper>'),
    ("text", "/Dockerfile", "FROM base~\n# RUN no\nRUN make ~\nENTRYPOINT [\"run\"]\n"),
    ("text", "sh", "#!/bin/sh\nbuild~() {\n  make all\n}\n"),
    ("text", "/Makefile", "all~: dep\n\tcc x~\nV := 1\n"),
    ("json", "json", "{broken ~"),
]


def config_tree(spark: SparkSession, d: str) -> DataFrame:
    return source_tree(spark, d, _CONFIGS)


@query(
    _rows(
        "path, fact_kind, key_path, value_preview, preview_masked, caveat",
        [
            (0, "'src/s$.json', 'config_key', 'db.host', 'h$', false, NULL"), (0, "'src/s$.json', 'config_key', 'db.password', '<masked>', true, NULL"), (0, "'src/s$.json', 'config_key', 'list[0].n', '$', false, NULL"),
            (2, "'src/s$.toml', 'config_key', 'tool.x.name', 'n$', false, NULL"), (2, "'src/s$.toml', 'config_key', 'tool.x.number', '$', false, NULL"),
            (7, "'src/s$.json', 'config_file', NULL, NULL, false, 'parse_failed'"),
        ],
    )
)
def structured_config(spark: SparkSession, d: str) -> DataFrame:
    found = config.structured_facts(config_tree(spark, d)).where("NOT (path LIKE '%.yml' OR path LIKE '%.xml')")
    return found.select("path", "fact_kind", "key_path", "value_preview", "preview_masked", "caveat")


@query(
    _rows(
        "path, fact_kind, key_path",
        [
            (3, "'src/s$.xml', 'mapper_namespace', 'n.M$'"), (3, "'src/s$.xml', 'mapper_result_map', 'n.M$.r'"), (3, "'src/s$.xml', 'mapper_sql_fragment', 'n.M$.c'"), (3, "'src/s$.xml', 'mapper_statement', 'n.M$.q$'"),
        ],
    )
)
def mapper_definitions(spark: SparkSession, d: str) -> DataFrame:
    return config.mapper_symbols(config.structured_facts(config_tree(spark, d))).select("path", "fact_kind", "key_path")


@query(_rows("path, fact_kind, key_path", [(3, "'src/s$.xml', 'mapper_reference', 'n.M$.r'"), (3, "'src/s$.xml', 'mapper_reference', 'n.M$.c'")]))
def mapper_references(spark: SparkSession, d: str) -> DataFrame:
    return config.mapper_symbols(config.structured_facts(config_tree(spark, d)), definitions=False).select("path", "fact_kind", "key_path").distinct()


@query(
    _rows(
        "path, fact_kind, key_path",
        [(1, "'src/s$.yml', 'workflow_job', 'jobs.build$'"), (1, "'src/s$.yml', 'config_key', 'version'"), (1, "'src/s$.yml', 'config_key', 'jobs.build$.steps[0].name'"), (1, "'src/s$.yml', 'config_key', 'jobs.build$.steps[0].run'")],
    )
)
def yaml_config(spark: SparkSession, d: str) -> DataFrame:
    found = config.structured_facts(config_tree(spark, d)).where("path LIKE '%.yml' AND fact_kind IN ('workflow_job', 'config_key')")
    return found.select("path", "fact_kind", "key_path")


@query(_rows("path, line, instruction, is_entrypoint", [(4, "'src/s$/Dockerfile', 1, 'FROM', false"), (4, "'src/s$/Dockerfile', 3, 'RUN', false"), (4, "'src/s$/Dockerfile', 4, 'ENTRYPOINT', true")]))
def dockerfile_instructions(spark: SparkSession, d: str) -> DataFrame:
    found = config.dockerfile_facts(config_tree(spark, d).where("path LIKE '%/Dockerfile'"))
    return found.select("path", "line", "instruction", "is_entrypoint")


@query(_rows("path, fact_kind, name", [(5, "'src/s$.sh', 'shell_entrypoint', '/bin/sh'"), (5, "'src/s$.sh', 'shell_function', 'build$'"), (5, "'src/s$.sh', 'shell_command', 'make'")]))
def shell_config(spark: SparkSession, d: str) -> DataFrame:
    return config.shell_facts(config_tree(spark, d).where("path LIKE '%.sh'")).select("path", "fact_kind", "name")


@query(_rows("path, target, recipe", [(6, "'src/s$/Makefile', 'all$', NULL"), (6, "'src/s$/Makefile', 'all$', 'cc x$'")]))
def make_targets(spark: SparkSession, d: str) -> DataFrame:
    return config.make_facts(config_tree(spark, d).where("path LIKE '%/Makefile'")).select("path", "target", "recipe")
