"""Catalogs of source trees: listing, sniffing, proofs, skips, git state."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators.search import line_offsets

MAX_FILE_BYTES = 10 << 20
SNIFFED_BYTES = 8192


@dataclass(frozen=True)
class Scope:
    """What part of a catalog a query reads; empty lists don't restrict."""

    directories: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    patterns: tuple = ()
    changed_only: bool = False

    def apply(self, catalog: DataFrame, changed: DataFrame | None = None) -> DataFrame:
        from tessera.functions.patterns import any_pattern

        path = F.col("path")
        kept = catalog.where(
            paths.in_directories(path, list(self.directories))
            & paths.has_extension(path, list(self.extensions))
            & any_pattern(path, list(self.patterns))
            & paths.substring_scope(path, list(self.include), list(self.exclude))
            & paths.language_scope(F.col("language"), list(self.languages))
        )
        if self.changed_only:
            if changed is None:
                raise ValueError("a changed-only scope needs the changed files")
            kept = kept.join(changed.select("path"), "path", "left_semi")
        return kept


#: Caps on what the driver lists and reads itself: files whose names Spark's
#: readers pass over, and the bytes in them.
HIDDEN_FILES, HIDDEN_BYTES = 10_000, 64 << 20
IGNORE_FILES = (".gitignore", ".ignore")


@dataclass(frozen=True)
class _Unseen:
    """What Spark's readers don't show of a tree: files with a component that
    starts with an underscore, and the ignore files."""

    files: list[tuple]
    ignores: list[tuple[str, str]]


def _unseen(spark: SparkSession, root: str, max_bytes: int, contents: bool = True) -> _Unseen:
    """Listed by the driver, and read within the caps; beyond them it is an error."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    files, ignores, taken = [], [], 0

    def read(status) -> bytearray:
        nonlocal taken
        taken += status.getLen()
        if taken > HIDDEN_BYTES:
            raise ValueError(f"more than {HIDDEN_BYTES} bytes below {root} are in files that only the driver can read")
        stream = fs.open(status.getPath())
        try:
            return bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    listed = fs.listFiles(top, True)
    while listed.hasNext():
        status = listed.next()
        path = status.getPath().toUri().getPath().removeprefix(prefix)
        *above, name = path.split("/")
        if any(p.startswith(".") for p in above):
            continue
        if name in IGNORE_FILES:
            ignores.append(("/".join(above), read(status).decode("utf-8", "replace")))
        elif not name.startswith(".") and any(p.startswith("_") for p in (*above, name)):
            if len(files) == HIDDEN_FILES:
                raise ValueError(f"more than {HIDDEN_FILES} files below {root} have names that Spark passes over")
            content = read(status) if contents and status.getLen() <= max_bytes else bytearray()
            files.append((path, status.getLen(), status.getModificationTime(), content))
    return _Unseen(files, ignores)


def _relative(root: str) -> Column:
    bare = root.split("://")[-1].split(":")[-1].rstrip("/")
    return F.expr(f"substring(path, instr(path, '{bare}/') + {len(bare) + 1})")


def looks_binary(content: Column) -> Column:
    """Whether a zero byte is among the first SNIFFED_BYTES."""
    return F.rlike(F.hex(F.substring(content, 1, SNIFFED_BYTES)), F.lit("^(?:..)*?00"))


_LISTED = "path string, size long, mtime_ms long"


def _skip_reason(path: Column, unseen: _Unseen, no_ignore: bool) -> Column:
    reason = F.when(paths.is_skipped(path, no_ignore), "ignored")
    return reason if no_ignore or not unseen.ignores else reason.when(paths.is_ignored(path, unseen.ignores), "ignored")


def list_tree(spark: SparkSession, root: str, no_ignore: bool = False, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, size, mtime_ms) of the files that a scan would look into; no content is read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = read.select(_relative(root).alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))
    unseen = _unseen(spark, root, max_bytes, contents=False)
    if unseen.files:
        files = files.unionByName(spark.createDataFrame([f[:3] for f in unseen.files], _LISTED))
    return files.where(_skip_reason(F.col("path"), unseen, no_ignore).isNull() & (F.col("size") <= max_bytes))


def scan_tree(spark: SparkSession, root: str, no_ignore: bool = False, max_bytes: int = MAX_FILE_BYTES, only: list[str] | None = None) -> DataFrame:
    """Every file below a root but hidden ones (a component that starts with a
    dot): path, language, size, mtime_ms, content (null if skipped), skip_reason
    ("ignored", also by ignore files, "too_large", "binary" or null).  Files over
    ``max_bytes`` are never read.  Reads through Spark, so the root may lie in any
    store it reaches.  ``only`` restricts the scan to a bounded list of paths."""
    unseen = _unseen(spark, root, max_bytes)
    seen = None if only is None else sorted(set(only) - {f[0] for f in unseen.files})
    reader = spark.read.format("binaryFile")
    if seen is None:
        listed = reader.option("recursiveFileLookup", "true").load(root)
        small = listed.where(F.col("length") <= max_bytes)  # pushed down, so larger ones are not read
        large = listed.where(F.col("length") > max_bytes).select("path", "length", "modificationTime", F.lit(None).cast("binary").alias("content"))
        listed = small.select("path", "length", "modificationTime", "content").unionByName(large)
    else:
        listed = reader.load([f"{root.rstrip('/')}/{p}" for p in seen]) if seen else None
    columns = [_relative(root).alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content"]
    files = spark.createDataFrame([f for f in unseen.files if only is None or f[0] in only], f"{_LISTED}, content binary")
    if listed is not None:
        files = listed.select(*columns).unionByName(files)
    reason = _skip_reason(F.col("path"), unseen, no_ignore).when(F.col("size") > max_bytes, "too_large").when(looks_binary(F.col("content")), "binary")
    judged = files.withColumn("skip_reason", reason)
    return judged.select("path", paths.language_of(F.col("path")).alias("language"), "size", "mtime_ms", F.when(F.col("skip_reason").isNull(), F.decode("content", "UTF-8")).alias("content"), "skip_reason")


def included(scan: DataFrame) -> DataFrame:
    return scan.where(F.col("skip_reason").isNull()).drop("skip_reason")


def skipped(scan: DataFrame) -> DataFrame:
    return scan.where(F.col("skip_reason").isNotNull()).select("path", F.lit("scan").alias("stage"), F.col("skip_reason").alias("reason"))


def scan_summary(scan: DataFrame) -> DataFrame:
    """One row: seen, included and skipped files by reason, bytes included."""
    has = F.col("skip_reason")
    counts = [F.count_if(has == r).alias(r) for r in ("ignored", "too_large", "binary")]
    return scan.agg(F.count(F.lit(1)).alias("seen"), F.count_if(has.isNull()).alias("included"), *counts, F.coalesce(F.sum(F.when(has.isNull(), F.col("size"))), F.lit(0)).alias("bytes"))


def with_proofs(files: DataFrame) -> DataFrame:
    """Adds hash (SHA-256 of the content) and line_offsets."""
    return files.withColumns({"hash": F.sha2("content", 256), "line_offsets": line_offsets(F.col("content"))})


def parse_git_status(status: DataFrame) -> DataFrame:
    """Porcelain v1 lines (value) to (path, previous_path, staged, unstaged, untracked)."""
    x, y, rest = F.substring("value", 1, 1), F.substring("value", 2, 1), F.expr("substring(value, 4)")
    renamed = F.contains(rest, F.lit(" -> ")) & (x.isin("R", "C") | y.isin("R", "C"))
    bare = lambda c: F.regexp_replace(c, '^"|"$', "")
    untracked = (x == "?") & (y == "?")
    return status.where(F.length("value") > 3).select(
        bare(F.when(renamed, F.split_part(rest, F.lit(" -> "), F.lit(2))).otherwise(rest)).alias("path"),
        F.when(renamed, bare(F.split_part(rest, F.lit(" -> "), F.lit(1)))).alias("previous_path"),
        (~x.isin(" ", "?")).alias("staged"),
        (~y.isin(" ", "?")).alias("unstaged"),
        untracked.alias("untracked"),
    )


def changed_summary(changed: DataFrame) -> DataFrame:
    return changed.agg(F.count(F.lit(1)).alias("changed"), *[F.count_if(c).alias(c) for c in ("staged", "unstaged", "untracked")])


@dataclass(frozen=True)
class Workspace:
    """State of a checkout; a folder without git has snapshot worktree:non-git."""

    root: str
    head: str | None
    dirty: bool

    @classmethod
    def discover(cls, root: str) -> Workspace:
        def git(*args: str) -> str | None:
            done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
            return done.stdout.strip() if done.returncode == 0 else None

        return cls(root, git("rev-parse", "HEAD"), bool(git("status", "--porcelain")))

    @property
    def snapshot_id(self) -> str:
        if self.head is None:
            return "worktree:non-git"
        return f"{'worktree' if self.dirty else 'commit'}:{self.head[:12]}"

    def staged_files(self, spark: SparkSession) -> DataFrame:
        """(path, blob, mode) of the index."""
        listed = subprocess.run(["git", "-C", self.root, "ls-files", "-s", "-z"], capture_output=True, text=True, check=True).stdout
        rows = [(path, meta.split()[1], int(meta.split()[0], 8)) for meta, path in (e.split("\t", 1) for e in listed.split("\0") if e)]
        return spark.createDataFrame(rows, "path string, blob string, mode int")

    def staged_content(self, path: str) -> bytes:
        return subprocess.run(["git", "-C", self.root, "show", f":{path}"], capture_output=True, check=True).stdout
