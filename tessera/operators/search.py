"""Text search: lines, matches with exact positions, context, catalog verbs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.functions.arrays import named, prefix_sums
from tessera.functions.grams import literal_grams
from tessera.functions.patterns import Pattern, word_bounded

FULL_READ_BYTES = 64 * 1024
PREVIEW_CHARS = 240


def lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1; the other columns are kept."""
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def _spans(text: Column, regex: str) -> Column:
    """array<struct<gap, m>>: the matches of a text, each with the text before it
    and behind the match before.  Splitting by the pattern gives the gaps, so all
    of it stays in the JVM."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    return F.zip_with(F.slice(F.split(text, regex, -1), F.lit(1), F.size(found)), found, lambda b, m: F.struct(b.alias("gap"), m.alias("m")))


def _positions(text: Column, regex: str) -> Column:
    """array<struct<column, match_text>> of the matches of a line."""

    def placed(pairs: Column) -> Column:
        before = prefix_sums(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["m"])))
        return F.zip_with(pairs, before, lambda p, at: F.struct((at + F.length(p["gap"]) + 1).cast("int").alias("column"), p["m"].alias("match_text")))

    return named(_spans(text, regex), placed)


def find_matches(files: DataFrame, pattern: Pattern, whole_word: bool = False, preview_chars: int = PREVIEW_CHARS) -> DataFrame:
    """Every non-overlapping, non-empty match: path, language, line, column,
    end_line, end_column (1-based, in characters; the end is exclusive),
    match_text, preview, preview_truncated, producer, reliability, exact.

    A pattern that can match a line break or is anchored is searched over whole
    contents, any other line by line; both in the same dialect."""
    regex = word_bounded(pattern.regex) if whole_word else pattern.regex
    files = files.select("path", "language", "content")
    if pattern.line_literal:
        files = files.where(F.contains(F.lower("content"), F.lit(pattern.line_literal.lower())))
    if pattern.spans_lines:
        return _in_contents(files, regex, preview_chars)
    hits = lines(files).where(F.rlike("text", F.lit(regex)))
    each = hits.select("path", "language", "line", "text", F.explode(_positions(F.col("text"), regex)).alias("m")).where("m.match_text <> ''")
    return each.select(
        "path",
        "language",
        "line",
        F.col("m.column").alias("column"),
        F.col("line").alias("end_line"),
        (F.col("m.column") + F.length("m.match_text")).alias("end_column"),
        F.col("m.match_text").alias("match_text"),
        *_evidence(F.col("text"), preview_chars),
    )


def _evidence(line_text: Column, preview_chars: int) -> list[Column]:
    shown = F.rtrim(line_text)
    cut = F.length(shown) > preview_chars
    return [
        F.when(cut, F.concat(F.substring(shown, 1, preview_chars), F.lit("…"))).otherwise(shown).alias("preview"),
        cut.alias("preview_truncated"),
        F.lit("text_search").alias("producer"),
        F.lit("source_fact").alias("reliability"),
        F.lit(True).alias("exact"),
    ]


def _in_contents(files: DataFrame, regex: str, preview_chars: int) -> DataFrame:
    """Matches of whole contents.  Lines are counted as line breaks before and in
    each match, columns from the start of the line; both are prefix sums."""
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))

    def placed(pairs: Column) -> Column:
        at = prefix_sums(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["m"])))
        line = prefix_sums(F.transform(pairs, lambda p: breaks(p["gap"]) + breaks(p["m"])))
        here = lambda p, z: F.struct(
            p["m"].alias("match_text"), (z["at"] + F.length(p["gap"])).alias("at"), (z["line"] + breaks(p["gap"])).cast("int").alias("line"),
            (z["line"] + breaks(p["gap"]) + breaks(p["m"])).cast("int").alias("end_line"),
        )
        return F.zip_with(pairs, F.arrays_zip(at.alias("at"), line.alias("line")), here)

    hits = files.where(F.rlike("content", F.lit(regex)))
    hits = hits.select("path", "language", F.split("content", "\n").alias("__lines"), named(_spans(F.col("content"), regex), placed).alias("__found"))
    starts = prefix_sums(F.transform("__lines", lambda t: F.length(t) + 1))
    each = hits.withColumn("__starts", starts).select("path", "language", "__lines", "__starts", F.explode("__found").alias("m")).where("m.match_text <> ''")
    column = lambda at, line: (at - F.col("__starts")[line] + 1).cast("int")
    end = F.col("m.at") + F.length("m.match_text")
    each = each.select(
        "path", "language", (F.col("m.line") + 1).alias("line"), column(F.col("m.at"), F.col("m.line")).alias("column"),
        (F.col("m.end_line") + 1).alias("end_line"), column(end, F.col("m.end_line")).alias("end_column"), F.col("m.match_text").alias("match_text"), F.col("__lines")[F.col("m.line")].alias("text"),
    )
    return each.select("path", "language", "line", "column", "end_line", "end_column", "match_text", *_evidence(F.col("text"), preview_chars))


def with_context(matches: DataFrame, files: DataFrame, around: int) -> DataFrame:
    """Adds context: the lines from ``around`` before to ``around`` after a match."""
    split = files.select("path", F.split("content", "\n").alias("__lines"))
    first = F.greatest(F.col("line") - around, F.lit(1))
    last = F.least(F.col("line") + around, F.size("__lines"))
    cells = F.transform(F.slice("__lines", first, last - first + 1), lambda t, i: F.struct((first + i).alias("line"), t.alias("text")))
    return matches.join(split, "path").withColumn("context", cells).drop("__lines")


def gram_hits(postings: DataFrame, literal: str, fold_case: bool) -> DataFrame | None:
    """Paths whose postings hold every trigram of the literal; the postings must
    have been built with the same case folding.  None if it has no trigram."""
    wanted = literal_grams(literal.lower() if fold_case else literal)
    if not wanted:
        return None
    hits = postings.where(F.col("gram").isin(wanted)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") == len(wanted)).select("path")


def prefiltered(files: DataFrame, postings: DataFrame, literal: str, fold_case: bool) -> DataFrame:
    """Files that may hold the literal; none that does is lost.  Files with a
    column source that is not "index" have no postings and stay."""
    hits = gram_hits(postings, literal, fold_case)
    if hits is None:
        return files
    indexed = files.where("source = 'index'") if "source" in files.columns else files
    kept = indexed.join(hits, "path", "left_semi")
    return kept.unionByName(files.where("source <> 'index'")) if "source" in files.columns else kept


def find_files(catalog: DataFrame, pattern: Pattern) -> DataFrame:
    """Catalog rows whose path matches, with the parts facets need."""
    return catalog.where(pattern.matches(F.col("path"))).select("path", "language", "size", paths.extension(F.col("path")).alias("extension"), paths.top_directory(F.col("path")).alias("top_dir"))


def list_directory(catalog: DataFrame, directory: str = ".", recursive: bool = False) -> DataFrame:
    """Entries of a directory: (path, entry, kind).  Below it only if ``recursive``."""
    inside = catalog.where(paths.in_directories(F.col("path"), [directory]))
    skip = 0 if directory.strip("/") in ("", ".") else len(directory.strip("/")) + 1
    rest = F.expr(f"substring(path, {skip + 1})")
    if recursive:
        return inside.select("path", rest.alias("entry"), F.lit("file").alias("kind"))
    first = F.split_part(rest, F.lit("/"), F.lit(1))
    entry = inside.select(first.alias("entry"), F.when(F.contains(rest, F.lit("/")), "directory").otherwise("file").alias("kind")).distinct()
    return entry.select(F.concat(F.expr(f"'{directory.strip('/') + '/' if skip else ''}'"), "entry").alias("path"), "entry", "kind")


def tree(catalog: DataFrame, max_depth: int, directory: str = ".") -> DataFrame:
    """Distinct directories and files down to ``max_depth`` levels: (path, depth, kind, files)."""
    inside = catalog.where(paths.in_directories(F.col("path"), [directory]))
    parts = F.split("path", "/")
    levels = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max_depth)))
    prefix = F.transform(levels, lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), n.alias("depth"), (n < F.size(parts)).alias("dir")))
    each = inside.select(F.explode(prefix).alias("p"))
    counted = each.groupBy(F.col("p.path").alias("path"), F.col("p.depth").alias("depth"), F.col("p.dir").alias("dir")).agg(F.count(F.lit(1)).alias("files"))
    return counted.select("path", "depth", F.when(F.col("dir"), "directory").otherwise("file").alias("kind"), "files")


def read_range(files: DataFrame, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(path, line, text, truncated) of one file or of a line range of it.  Whole
    reads stop at FULL_READ_BYTES, at a character boundary."""
    one = files.where(F.col("path") == path)
    if first is not None:
        kept = lines(one.select("path", "content")).where(F.col("line").between(first, last if last is not None else first))
        return kept.select("path", "line", "text", F.lit(False).alias("truncated"))
    raw = F.col("content").cast("binary")
    big = F.octet_length("content") > FULL_READ_BYTES
    whole = F.regexp_replace(F.decode(F.substring(raw, 1, FULL_READ_BYTES), "UTF-8"), "�$", "")
    cut = one.select("path", big.alias("truncated"), F.when(big, whole).otherwise(F.col("content")).alias("content"))
    return lines(cut).select("path", "line", "text", "truncated")


_TOKENS = "path string, language string, line int, column int, name string"
_BATCH_ROWS = 1 << 16


def tokens(files: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """ASCII identifiers with positions: (path, language, line, column, name), in
    Arrow batches.  With ``parts`` only those that hold one of them, case ignored;
    contents and lines without any are passed over first."""
    files = files.select("path", "language", "content")
    wanted = [p.lower() for p in parts or []]
    if wanted:
        has = F.lit(False)
        for part in wanted:
            has = has | F.contains(F.lower("content"), F.lit(part))
        files = files.where(has)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile("[A-Za-z_][A-Za-z0-9_]*")
        names = [f.split()[0] for f in _TOKENS.split(", ")]

        def flush(part: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
            row, line, column, name = zip(*found) if found else ([],) * 4
            here = pa.array(row, pa.int32())
            return pa.RecordBatch.from_arrays([part.column(0).take(here), part.column(1).take(here), pa.array(line, pa.int32()), pa.array(column, pa.int32()), pa.array(name, pa.string())], names)

        for part in batches:
            found: list[tuple] = []
            for row, content in enumerate(part.column(2).to_pylist()):
                for n, line in enumerate((content or "").split("\n"), 1):
                    if wanted:
                        low = line.lower()
                        if not any(p in low for p in wanted):
                            continue
                        found += [(row, n, m.start() + 1, m[0]) for m in word.finditer(line) if any(p in m[0].lower() for p in wanted)]
                    else:
                        found += [(row, n, m.start() + 1, m[0]) for m in word.finditer(line)]
                if len(found) >= _BATCH_ROWS:
                    yield flush(part, found)
                    found = []
            yield flush(part, found)

    return files.mapInArrow(run, _TOKENS)


def line_offsets(content: Column) -> Column:
    """Byte offset of the start of each line."""
    return F.transform(prefix_sums(F.transform(F.split(content, "\n"), lambda t: F.octet_length(t) + 1)), lambda x: x.cast("int"))
