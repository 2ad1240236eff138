"""Project roots, ownership of files, and the edges that configuration adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths

# Marker files, the language and kind of root they make, and which
# wins where a directory has several (smaller first).
MARKERS = {
    "go.work": ("go", "go_workspace", 0),
    "go.mod": ("go", "go_module", 1),
    "Cargo.toml": ("rust", "rust_cargo", 0),
    "pom.xml": ("java", "java_maven", 0),
    "settings.gradle": ("java", "java_gradle", 1),
    "settings.gradle.kts": ("java", "java_gradle", 1),
    "build.gradle": ("java", "java_gradle", 2),
    "build.gradle.kts": ("java", "java_gradle", 2),
    "tsconfig.json": ("typescript", "type_script_config", 0),
    "jsconfig.json": ("typescript", "type_script_config", 1),
    "package.json": ("typescript", "type_script_package", 2),
    "Gemfile": ("ruby", "ruby_gemfile", 0),
    "Package.swift": ("swift", "swift_package", 0),
}
# Kinds of configuration and automation files by name or place.
CONFIG_KINDS = {
    "ci_workflow": r"(^|/)\.github/workflows/[^/]+\.ya?ml$|(^|/)\.gitlab-ci\.yml$",
    "compose": r"(^|/)(docker-)?compose[^/]*\.ya?ml$",
    "container": r"(^|/)(Dockerfile|Containerfile)(\.[^/]+)?$",
    "environment": r"(^|/)\.env(\.[^/]+)?$",
    "script": r"(^|/)(Makefile|[^/]+\.mk|[^/]+\.sh)$",
    "dependency": r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|go\.sum|Gemfile\.lock|requirements[^/]*\.txt|poetry\.lock)$",
    "settings": r"\.(properties|ini|conf|cfg|toml|ya?ml|json|xml)$",
}


def discover_roots(files: DataFrame) -> DataFrame:
    """(id, path, language, kind, markers): one root per directory and language."""
    table = F.create_map(*[x for name, (lang, kind, rank) in MARKERS.items() for x in (F.lit(name), F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(lang).alias("language")))])
    marked = files.select(paths.parent(F.col("path")).alias("path"), paths.file_name(F.col("path")).alias("name"))
    gem = F.when(F.col("name").endswith(".gemspec"), F.struct(F.lit(1).alias("rank"), F.lit("ruby_gemspec").alias("kind"), F.lit("ruby").alias("language")))
    marked = marked.withColumn("m", F.coalesce(F.element_at(table, F.col("name")), gem)).where(F.col("m").isNotNull())
    return marked.groupBy("path", F.col("m.language").alias("language")).agg(F.min_by("m.kind", F.struct("m.rank", "name")).alias("kind"), F.array_sort(F.collect_set("name")).alias("markers")).select(F.concat_ws(":", "language", "path").alias("id"), "path", "language", "kind", "markers")


def ancestors(path: Column) -> Column:
    """The directories above a path from "." down, the deepest last."""
    parts = F.split(path, "/")
    inner = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.concat(F.array(F.lit(".")), F.when(F.size(parts) > 1, inner).otherwise(F.array().cast("array<string>")))


def nearest_roots(files: DataFrame, roots: DataFrame, same_language: bool = True) -> DataFrame:
    """Files with the id of the deepest root above them, or null.

    Resolved once per distinct directory and language, by an equality join on
    the directory's ancestors, whose number is the depth of the path."""
    keys = ["__dir", "language"] if same_language else ["__dir"]
    placed = files.withColumn("__dir", paths.parent(F.col("path")))
    up = placed.select(*keys).distinct().withColumn("__up", F.explode(F.array_distinct(F.concat(ancestors(F.concat(F.col("__dir"), F.lit("/x"))), F.array("__dir")))))
    r = roots.select(F.col("path").alias("__up"), F.col("id").alias("root_id"), *(["language"] if same_language else []))
    near = up.join(r, ["__up", *keys[1:]]).groupBy(*keys).agg(F.max_by("root_id", F.struct(F.when(F.col("__up") == ".", 0).otherwise(F.length("__up")), "root_id")).alias("root_id"))
    return placed.join(near, keys, "left").drop("__dir")


def config_files(files: DataFrame) -> DataFrame:
    kind = F.lit(None).cast("string")
    for name, regex in reversed(CONFIG_KINDS.items()):
        kind = F.when(F.rlike("path", F.lit(regex)), name).otherwise(kind)
    return files.select("path", kind.alias("config_kind")).where(F.col("config_kind").isNotNull())


def config_edges(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, config_kind, root_ids, caveat): a configuration file touches the
    nearest root; a shared one (at the top or under config/) touches all roots."""
    found = config_files(files)
    first = paths.top_directory(F.col("path"))
    shared = ~F.contains("path", F.lit("/")) | first.isin("config", ".config")
    near = nearest_roots(found, roots, same_language=False)
    every = roots.agg(F.array_sort(F.collect_set("id")).alias("every"))  # roots are marker directories, one row holds them
    joined = near.crossJoin(every).withColumn("root_ids", F.when(shared, F.col("every")).when(F.col("root_id").isNotNull(), F.array("root_id")).otherwise(F.array().cast("array<string>")))
    return joined.select("path", "config_kind", "root_ids", F.when(F.size("root_ids") == 0, "config_edge_unresolved").alias("caveat"))


# Files that say where a program runs, by name or place.
ENVIRONMENT_KINDS = {
    "container": r"(^|/)Dockerfile(\.[^/]*)?$",
    "compose": r"(?i)compose\.ya?ml$",
    "dot_env": r"(^|/)\.env(\.[^/]*)?$",
    "kubernetes": r"(?i)(^|/)(k8s|kubernetes)/",
}
# What an edge of each kind of configuration means.
EDGE_KINDS = {"dependency": "dependency_config_affects_root", "script": "automation_affects_root", "ci_workflow": "automation_affects_root", "settings": "runtime_config_affects_root"}


def environment_files(files: DataFrame) -> DataFrame:
    kind = F.lit(None).cast("string")
    for name, regex in reversed(ENVIRONMENT_KINDS.items()):
        kind = F.when(F.rlike("path", F.lit(regex)), name).otherwise(kind)
    return files.select("path", kind.alias("environment")).where(F.col("environment").isNotNull())


def environment_edges(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, environment, root_ids, caveat): such a file touches every root."""
    every = roots.agg(F.array_sort(F.collect_set("id")).alias("root_ids"))  # roots are marker directories, one row holds them
    found = environment_files(files).crossJoin(every)
    return found.withColumn("caveat", F.when(F.size("root_ids") == 0, "config_edge_unresolved"))


def root_dependencies(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(from_root_id, to_root_id, via_path): a Go workspace depends on the Go roots
    below its directory, found by an equality join on their ancestors."""
    go = roots.where("language = 'go'").select(F.col("id").alias("to_root_id"), "path")
    spaces = files.where(paths.file_name(F.col("path")) == "go.work").select(F.col("path").alias("via_path"), paths.parent(F.col("path")).alias("__dir"))
    own = spaces.join(go.select(F.col("path").alias("__dir"), F.col("to_root_id").alias("from_root_id")), "__dir")
    below = go.where("path <> '.'").withColumn("__dir", F.explode(ancestors(F.col("path"))))
    return own.join(below, "__dir").where("from_root_id <> to_root_id").select("from_root_id", "to_root_id", "via_path")


def dependency_edges(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(kind, from_root_id, to_root_id, via_path, unresolved): what each file of
    configuration or environment affects, one row a root, or one unresolved row; and
    the roots that a workspace depends on.  A file that affects one root is its own."""
    marker = paths.file_name(F.col("path")).isin(list(MARKERS))
    kinds = F.create_map(*[F.lit(v) for item in EDGE_KINDS.items() for v in item])
    by_config = config_edges(files, roots).where(~F.col("config_kind").isin("container", "compose", "environment"))
    by_config = by_config.select(F.when(marker, "build_config_affects_root").otherwise(kinds[F.col("config_kind")]).alias("kind"), F.when(F.size("root_ids") == 1, F.col("root_ids")[0]).alias("from_root_id"), "root_ids", "path")
    around = environment_edges(files, roots).select(F.lit("environment_affects_root").alias("kind"), F.lit(None).cast("string").alias("from_root_id"), "root_ids", "path")
    each = by_config.unionByName(around).select("kind", "from_root_id", F.explode_outer("root_ids").alias("to_root_id"), F.col("path").alias("via_path"))
    each = each.withColumn("unresolved", F.col("to_root_id").isNull())
    between = root_dependencies(files, roots).select(F.lit("root_depends_on_root").alias("kind"), "from_root_id", "to_root_id", "via_path", F.lit(False).alias("unresolved"))
    return each.unionByName(between)


def generated_sources(files: DataFrame) -> DataFrame:
    return files.select("path", paths.generated_reason(F.col("path")).alias("reason")).where(F.col("reason").isNotNull())
