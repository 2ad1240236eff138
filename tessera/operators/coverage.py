"""Coverage of languages, alignment of diffs, and caps on attached code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths

# Which coverage wins where the roots of a language differ.
COVERAGE_ORDER = ["partial", "manual_required", "missing", "fresh"]
# When results are too many and too mixed to show all their code.
MANY, SHOWN, MAX_LINES, MAX_BYTES, BYTES_A_LINE = 8, 3, 120, 8 * 1024, 80
RELATIONS = 12


def language_coverage(roots: DataFrame) -> DataFrame:
    """roots (root_id, language, provider, state, reason) to (language, provider,
    precise, roots, partial_reasons)."""
    place = F.array_position(F.array(*map(F.lit, COVERAGE_ORDER)), F.col("state"))
    return roots.groupBy("language").agg(
        F.coalesce(F.min("provider"), F.lit("unknown")).alias("provider"),
        F.min_by("state", place).alias("precise"),
        F.countDistinct("root_id").alias("roots"),
        F.array_sort(F.collect_set("reason")).alias("partial_reasons"),
    )


def misaligned_files(diff_files: DataFrame, blocked: DataFrame) -> DataFrame:
    """Files of a diff (path) while any root is blocked (root_id), with how many are."""
    count = blocked.agg(F.countDistinct("root_id").alias("blocked_roots"))
    return diff_files.select("path").crossJoin(count).where("blocked_roots > 0")  # the count is one row


def visible_code(results: DataFrame) -> DataFrame:
    """One row: how many of a page's results (path, kind, container, lines) show
    their code; null means all."""
    group = F.concat_ws(":", F.coalesce("kind", F.lit("")), F.coalesce("container", F.lit("")), paths.top_directory(F.col("path")))
    totals = results.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(group).alias("groups"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    mixed = (F.col("groups") > 1) | (F.col("lines") > MAX_LINES) | (F.col("lines") * BYTES_A_LINE > MAX_BYTES)
    return totals.select("n", "groups", "lines", F.when((F.col("n") >= MANY) & mixed, F.least(F.lit(SHOWN), F.col("n"))).alias("visible"))
