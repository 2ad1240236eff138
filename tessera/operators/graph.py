"""Call graphs and type graphs as node and edge tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import identifiers as ids
from tessera.operators.lineage import cut
from tessera.operators.results import first_per
from tessera.operators.scheduler import cap_candidates
from tessera.plans.inputs import InputPlan

MAX_DEPTH = 8
SITE = ["language", "file_path", "call_line", "caller_id", "target"]


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge per (caller, callee, file, line, column)."""
    return edges.dropDuplicates(["caller_id", "callee_id", "file_path", "call_line", "call_column"])


def calls(edges: DataFrame, callers: DataFrame) -> DataFrame:
    """Edges that leave the matched nodes (id)."""
    return edges.join(callers.select(F.col("id").alias("caller_id")), "caller_id", "left_semi")


def with_symbols(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds name and kind of the caller and of the callee from symbols (id, name,
    kind), null where there is no such symbol."""
    for side in ("caller", "callee"):
        own = symbols.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("kind").alias(f"{side}_kind"))
        edges = edges.join(own, f"{side}_id", "left")
    return edges


def in_files(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges, or any rows with a file_path, in the allowed files (path)."""
    return edges.join(allowed.select(F.col("path").alias("file_path")), "file_path", "left_semi")


def callable_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes a call hierarchy can start from: functions with a place in a file."""
    return nodes.where(F.col("kind").isin("function", "method", "constructor") & (F.coalesce("file_path", F.lit("")) != "") & (F.col("start_line") > 0))


def qualified_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes that a qualified name means: the last part is the name, the part
    before it the tail of the container; case is ignored.  Other texts restrict
    nothing."""
    plain = re.sub(r"::|#|\$", ".", text.split("(")[0].strip())
    container, _, name = plain.rpartition(".")
    if not container:
        return nodes
    tail = F.element_at(F.split(F.regexp_replace(F.coalesce("container", F.lit("")), r"::|#|\$", "."), r"\."), -1)
    return nodes.where((F.lower("name") == name.lower()) & (F.lower(tail) == container.rpartition(".")[2].lower()))


NODE_COLUMNS = ["id", "display_name"]


def matching_nodes(nodes: DataFrame, plan: InputPlan) -> DataFrame:
    """Nodes of which the id, the display name, or the tail or base of either
    matches the plan, with the kind of match."""
    forms = [f(F.col(c)) for c in NODE_COLUMNS for f in (lambda x: x, ids.qualified_tail, ids.method_base)]
    return nodes.withColumn("matched", plan.matched_kind(forms)).where(F.col("matched").isNotNull())


def hierarchy_roots(matched: DataFrame) -> DataFrame:
    """One node for each (language, file_path, container, name): that with the best
    rank, then the smallest id."""
    return first_per(matched, ["language", "file_path", "container", "name"], ["rank", "id"])


def capped_relations(relations: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` relations of each result, with a flag where some were cut."""
    return cap_candidates(relations.withColumn("__k", F.struct(*keys)), "__k", order, most).drop("__k")


def resolve_callers(calls_: DataFrame, definitions: DataFrame) -> DataFrame:
    """Adds caller_id: the only definition with the call's body hash, else the only
    one with its language, root, container and enclosing name, else null."""
    scope = ["language", "root_id", "container", "enclosing"]
    found = definitions.withColumnRenamed("name", "enclosing")
    by_hash = resolve_unique(calls_, found.where(F.col("body_hash").isNotNull()), ["body_hash"]).withColumnRenamed("callee_id", "__h")
    both = resolve_unique(by_hash, found, scope).withColumnRenamed("callee_id", "__s")
    return both.withColumn("caller_id", F.coalesce("__h", "__s")).drop("__h", "__s")


def build_edges(references: DataFrame, precise: DataFrame, parsed_calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """All edges of a snapshot: caller_id, callee_id, file_path, call_line,
    call_column, source.

    references (ref_id, path, line, column, symbol) go from the precise definition
    (def_id, path, start_line, end_line) around them to the symbol's definition;
    parsed_calls (language, root_id, path, line, column, container, enclosing,
    body_hash, target) from the definition resolve_callers finds to the only one
    (def_id, language, root_id, container, name, body_hash) that has the target's
    name in the language and root, else to the raw target.  A parsed call at a
    place that has a precise edge is dropped."""
    from_ = enclosing_definitions(references, precise).select("ref_id", F.col("def_id").alias("caller_id"))
    sure = references.join(from_, "ref_id").where(F.col("caller_id").isNotNull() & (F.col("caller_id") != F.col("symbol")))
    place = [F.col("path").alias("file_path"), F.col("line").alias("call_line"), F.col("column").alias("call_column")]
    sure = sure.select("caller_id", F.col("symbol").alias("callee_id"), *place, F.lit("precise").alias("source"))
    guessed = resolve_callers(parsed_calls, definitions).where(F.col("caller_id").isNotNull())
    targets = definitions.select("language", "root_id", F.col("name").alias("target"), "def_id")
    guessed = resolve_unique(guessed, targets, ["language", "root_id", "target"])
    guessed = guessed.select("caller_id", F.coalesce("callee_id", F.concat(F.lit("name:"), "target")).alias("callee_id"), *place, F.lit("parser").alias("source"))
    guessed = guessed.join(sure.select("file_path", "call_line", "call_column").distinct(), ["file_path", "call_line", "call_column"], "left_anti")
    return distinct_edges(sure.unionByName(guessed.select(sure.columns)))


def callers(edges: DataFrame, callees: DataFrame) -> DataFrame:
    return edges.join(callees.select(F.col("id").alias("callee_id")), "callee_id", "left_semi")


def hierarchy(edges: DataFrame, roots: DataFrame, depth: int = 2, limit: int = 0, incoming: bool = False) -> DataFrame:
    """Paths of at most ``depth`` edges from the roots (id), without repeating a
    node on a path: (root, depth, node, route).  With ``limit`` each node on a
    path keeps its first ``limit`` neighbours by name.

    One join a level; parallel edges are one neighbour."""
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}, not {depth}")
    near, far = ("callee_id", "caller_id") if incoming else ("caller_id", "callee_id")
    step = edges.select(F.col(near).alias("node"), F.col(far).alias("next")).distinct()
    front = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.array("id").alias("route")).distinct()
    found: DataFrame | None = None
    for level in range(1, depth + 1):
        ahead = front.join(step, "node").where(~F.array_contains("route", F.col("next")))
        if limit:
            n = F.row_number().over(Window.partitionBy("root", "route").orderBy("next"))
            ahead = ahead.withColumn("__n", n).where(F.col("__n") <= limit)
        front = ahead.select("root", F.col("next").alias("node"), F.concat("route", F.array("next")).alias("route"))
        rows = front.select("root", F.lit(level).alias("depth"), "node", "route")
        found = rows if found is None else found.unionByName(rows)
    return found


def enclosing_definitions(references: DataFrame, definitions: DataFrame, block: int = 16) -> DataFrame:
    """For each reference (ref_id, path, line, column) the innermost definition
    (def_id, path, start_line, end_line) that holds it, else the nearest that
    starts before it in the file; ties go to the smallest def_id.

    Every reference of a line has the same answer, so lines are solved once.
    Containment is an equality join on line blocks: a definition is listed under
    every block it spans, once for each place it takes.  The fallback is a running
    maximum over a file's lines."""
    points = references.select("path", "line").distinct()
    places = definitions.groupBy("path", "start_line", "end_line").agg(F.min("def_id").alias("def_id"))
    p = points.withColumn("__b", F.expr(f"line div {block}"))
    d = places.select("def_id", "path", "start_line", "end_line", F.explode(F.sequence(F.expr(f"start_line div {block}"), F.expr(f"end_line div {block}"))).alias("__b"))
    holds = p.join(d, ["path", "__b"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    inner = holds.groupBy("path", "line").agg(F.min(F.struct((-F.col("start_line")).alias("o"), "def_id")).alias("m")).select("path", "line", F.col("m.def_id").alias("inner_id"))
    starts = places.groupBy("path", F.col("start_line").alias("line")).agg(F.min("def_id").alias("start_id"))
    both = points.join(starts, ["path", "line"], "full").join(inner, ["path", "line"], "left")
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    solved = both.withColumn("before_id", F.last("start_id", ignorenulls=True).over(order)).select("path", "line", "inner_id", "before_id")
    how = F.when(F.col("inner_id").isNotNull(), "contains").when(F.col("before_id").isNotNull(), "precedes")
    return references.select("ref_id", "path", "line").join(solved, ["path", "line"], "left").select("ref_id", F.coalesce("inner_id", "before_id").alias("def_id"), how.alias("how"))


def resolve_unique(calls_: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """Adds callee_id where exactly one definition (def_id) has the call's keys."""
    one = definitions.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("def_id").alias("callee_id")).where("__n = 1").drop("__n")
    return calls_.join(one, keys, "left")


def prefer_precise(candidates: DataFrame) -> DataFrame:
    """Drop heuristic candidates at sites that have a precise one (columns don't
    count), then one row per site and source."""
    precise = candidates.where(F.col("reliability") == "precise_fact").select(*SITE).distinct()
    guessed = candidates.where(F.coalesce(F.col("reliability"), F.lit("")) != "precise_fact").join(precise, SITE, "left_anti")
    return candidates.where(F.col("reliability") == "precise_fact").unionByName(guessed).dropDuplicates([*SITE, "source"])


def inside_call_sites(references: DataFrame, sites: DataFrame) -> DataFrame:
    """References (path, line, column, name) within a parsed call site of that name."""
    s = sites.select("path", F.col("target").alias("name"), F.struct("start_line", "start_column").alias("__a"), F.struct("end_line", "end_column").alias("__b"))
    on = (references["path"] == s["path"]) & (references["name"] == s["name"])
    point = F.struct(references["line"], references["column"])
    return references.join(s, on & (point >= s["__a"]) & (point <= s["__b"]), "left_semi")


def type_closure(type_edges: DataFrame) -> DataFrame:
    """(subtype, supertype, depth): every pair reachable over subtype edges with
    the fewest steps, however many; cycles end the walk.

    Distances double each round: a shortest path of more than d and at most 2 d
    steps goes on from a pair exactly d apart by a known pair, so a round joins
    only those, and a chain of n types takes log2(n) rounds."""
    pairs = type_edges.select("subtype", "supertype").where("subtype <> supertype").distinct()
    known, reach = cut(pairs.withColumn("depth", F.lit(1))), 1
    while True:
        onward = known.select(F.col("subtype").alias("__m"), F.col("supertype").alias("__s"), F.col("depth").alias("__d"))
        ahead = known.where(F.col("depth") == reach).join(onward, F.col("supertype") == F.col("__m"))
        ahead = ahead.select("subtype", F.col("__s").alias("supertype"), (F.col("depth") + F.col("__d")).alias("depth")).where("subtype <> supertype")
        ahead = ahead.groupBy("subtype", "supertype").agg(F.min("depth").alias("depth"))
        new = cut(ahead.join(known, ["subtype", "supertype"], "left_anti"))
        if new.isEmpty():
            return known
        known, reach = cut(known.unionByName(new)), 2 * reach


def _one_of_each(raw_calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls that ask for the same have the same answer: the rows of one call of each
    kind, and (call_id, asks_as) that names it for every call.  What a call asks for
    is the set of its rows, so a repeated call_id is one call."""
    row = F.struct("receiver_type", "target_name", "arg_count", "arg_types")
    asked = raw_calls.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.array_sort(F.collect_set(row)).alias("ask"))
    one = asked.groupBy("ask").agg(F.min("call_id").alias("asks_as"))
    return one.select(F.col("asks_as").alias("call_id"), F.inline("ask")), asked.join(one, "ask").select("call_id", "asks_as")


def _method_classes(methods: DataFrame) -> DataFrame:
    """Methods that differ by id only are one row, under the smallest id, with their
    number n; an id of several rows stands for itself."""
    rows = methods.select("method_id", "owner", "name", "arity", "parameters").distinct()
    often = rows.groupBy("method_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("method_id", F.col("method_id").alias("__own"))
    same = ["owner", "name", "arity", "parameters", "__own"]
    return rows.join(often, "method_id", "left").groupBy(*same).agg(F.min("method_id").alias("method_id"), F.count(F.lit(1)).alias("n")).drop("__own")


def resolve_calls(raw_calls: DataFrame, methods: DataFrame, closure: DataFrame) -> DataFrame:
    """raw_calls: (call_id, receiver_type, target_name, arg_count, arg_types);
    methods: (method_id, owner, name, arity, parameters).  Candidates are the
    receiver's own methods of that name and arity, else its supertypes'; the
    candidates with the smallest argument score stay: 0 for an equal type, 1 for
    a supertype, 5 for an unknown argument, 10 for Object, none if it can't
    take the argument.  (call_id, status, callee, candidates).

    Calls and methods meet as kinds of calls and classes of equal methods, so the
    work follows the different questions and not calls times candidates."""
    asked, known_as = _one_of_each(raw_calls)
    asked, classes = cut(asked), cut(_method_classes(methods))
    key = [F.col("target_name") == F.col("name"), F.col("arg_count") == F.col("arity")]
    own = asked.join(classes, [*key, F.col("receiver_type") == F.col("owner")]).withColumn("far", F.lit(0))
    types = asked.select(F.col("receiver_type").alias("__t")).unionByName(asked.select(F.explode("arg_types").alias("__t"))).distinct()
    up = cut(closure.select(F.col("subtype").alias("__t"), F.col("supertype").alias("__o"), "depth").join(types, "__t", "left_semi"))
    owners = classes.select(F.col("owner").alias("__o")).distinct()
    above = asked.join(up.join(owners, "__o", "left_semi"), F.col("receiver_type") == F.col("__t")).join(classes, [*key, F.col("__o") == F.col("owner")])
    columns = ["call_id", "method_id", "n", "arg_types", "parameters"]
    found = own.select(*columns, "far").unionByName(above.select(*columns, F.lit(1).alias("far"))).distinct()
    nearest = found.groupBy("call_id").agg(F.min("far").alias("near"))
    found = found.join(nearest, "call_id").where("far = near")
    args = found.select("call_id", "method_id", "n", F.posexplode_outer(F.arrays_zip(F.col("arg_types").alias("a"), F.col("parameters").alias("p"))).alias("at", "z")).select("call_id", "method_id", "n", F.col("z.a").alias("a"), F.col("z.p").alias("p"))
    scored = args.join(up, (F.col("a") == F.col("__t")) & (F.col("p") == F.col("__o")), "left")
    each = F.when(F.col("a").isNull(), 5).when(F.col("p").isin("Object", "java.lang.Object"), 10).when(F.col("a") == F.col("p"), 0).when(F.col("depth").isNotNull(), 1)
    none = F.col("a").isNull() & F.col("p").isNull()
    total = scored.select("call_id", "method_id", "n", F.when(none, 0).otherwise(each).alias("s"))
    total = total.groupBy("call_id", "method_id").agg(F.max("n").alias("n"), F.sum("s").alias("score"), F.bool_or(F.col("s").isNull()).alias("misfit"))
    total = total.withColumn("score", F.when(F.col("misfit"), F.lit(None)).otherwise(F.col("score")))
    best = total.groupBy("call_id").agg(F.min("score").alias("best"))
    kept = total.join(best, "call_id").where(F.col("best").isNull() | (F.col("score") == F.col("best")))
    summary = kept.groupBy(F.col("call_id").alias("asks_as")).agg(F.sum("n").alias("candidates"), F.min("method_id").alias("one"))
    answers = known_as.join(cut(summary), "asks_as")
    status = F.when(F.coalesce("candidates", F.lit(0)) == 0, "unresolved").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous")
    return raw_calls.select("call_id").join(answers, "call_id", "left").select("call_id", status.alias("status"), F.when(F.col("candidates") == 1, F.col("one")).alias("callee"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def override_callees(resolved: DataFrame, methods: DataFrame, closure: DataFrame) -> DataFrame:
    """(call_id, callee): the resolved method and its overrides in subtypes.  The
    overrides are found once for each (owner, name, arity), among subtypes that
    have methods."""
    base = cut(resolved.where(F.col("callee").isNotNull()).select("call_id", "callee"))
    called = base.select("callee").distinct().join(methods.select(F.col("method_id").alias("callee"), F.col("owner").alias("__o"), "name", "arity"), "callee").distinct()
    below = methods.select(F.col("owner").alias("subtype"), "name", "arity", "method_id").distinct()
    down = closure.select(F.col("supertype").alias("__o"), "subtype").join(below.select("subtype").distinct(), "subtype", "left_semi")
    over = called.select("__o", "name", "arity").distinct().join(down, "__o").join(below, ["subtype", "name", "arity"]).select("__o", "name", "arity", "method_id").distinct()
    found = called.join(over, ["__o", "name", "arity"]).select("callee", "method_id")
    more = base.join(found, "callee").select("call_id", F.col("method_id").alias("callee"))
    return base.unionByName(more).distinct()
