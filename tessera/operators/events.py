"""Folding of file events into one change per path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import is_skipped

KINDS = ["create", "modify", "rename", "rename_from", "rename_to", "metadata", "remove"]


def next_change(change: Column, kind: Column) -> Column:
    """The pending change of a path after one more event.  The first change
    stays, but for three pairs: data edits turn an addition into a modification,
    a complete rename replaces whatever came before, and removing an added file
    leaves nothing."""
    first = F.when(kind.isin("create", "rename_to"), "added").when(kind.isin("modify", "metadata"), "modified").when(kind == "rename_from", "renamed").when(kind == "remove", "deleted")
    return (
        F.when(kind == "rename", "renamed")
        .when(change.isNull(), first)
        .when((kind == "modify") & (change == "added"), "modified")
        .when((kind == "remove") & (change == "added"), F.lit(None))
        .otherwise(change)
    )


STATES = ["added", "modified", "deleted", "renamed"]
#: Events of one path that a task folds at once, by sequence number.
CHUNK = 4096
_KEPT = "\x00"


def fold_events(events: DataFrame) -> DataFrame:
    """events (path, seq, kind, previous_path) to (path, change, previous_path,
    events), in order of seq; paths whose changes cancel have no row.

    The fold is a small automaton, so a run of events is a function from the
    pending change before it to the one after it, and functions compose.  Runs of
    at most CHUNK sequence numbers are folded first, from every pending change;
    then a path's functions are applied in order.  A path that has a third of all
    events is spread over tasks like any other."""
    seen = events.where(~is_skipped(F.col("path")))
    runs = seen.groupBy("path", F.expr(f"seq div {CHUNK}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "previous_path"))).alias("e"))
    kind = "struct<change:string,previous:string>"

    def step(s: Column, e: Column) -> Column:
        change = next_change(s["change"], e["kind"])
        previous = F.when(e["kind"] == "rename", e["previous_path"]).when(change.isNull(), F.lit(None)).otherwise(s["previous"])
        return F.struct(change.alias("change"), previous.alias("previous")).cast(kind)

    begin = F.array(*[F.struct(F.lit(s).cast("string").alias("change"), F.lit(_KEPT).alias("previous")).cast(kind) for s in [None, *STATES]])
    outcomes = F.transform(begin, lambda b: F.aggregate("e", b, step))
    folded = runs.select("path", "run", outcomes.alias("f"), F.size("e").alias("n"))

    def apply(s: Column, r: Column) -> Column:
        place = F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), s["change"]), F.lit(0)).cast("int")
        out = F.get(r["f"], place)
        previous = F.when(out["previous"] == _KEPT, s["previous"]).otherwise(out["previous"])
        return F.struct(out["change"].alias("change"), previous.alias("previous")).cast(kind)

    start = F.struct(F.lit(None).cast("string").alias("change"), F.lit(None).cast("string").alias("previous")).cast(kind)
    whole = folded.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("run", "f"))).alias("r"), F.sum("n").cast("int").alias("events"))
    done = whole.select("path", F.aggregate("r", start, apply).alias("f"), "events")
    return done.select("path", F.col("f.change").alias("change"), F.col("f.previous").alias("previous_path"), "events").where(F.col("change").isNotNull())


def tumbling_changes(events: DataFrame, window: str) -> DataFrame:
    """Events per fixed window and kind; windows start at the epoch."""
    kept = events.where(~is_skipped(F.col("path")))
    return kept.groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("path").alias("paths")).select(F.col("w.start").alias("window_start"), "kind", "events", "paths")
