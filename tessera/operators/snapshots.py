"""Snapshots: reconciliation, freshness, overlay, digests and state tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAST = ["size", "mtime_ms", "mode"]


def reconcile(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status, expected_hash, actual_hash) of files that differ:
    dirty, added or deleted."""
    s = snapshot.select("path", F.col("hash").alias("expected_hash"))
    c = current.select("path", F.col("hash").alias("actual_hash"))
    joined = s.join(c, "path", "full")
    status = F.when(F.col("expected_hash").isNull(), "added").when(F.col("actual_hash").isNull(), "deleted").when(F.col("expected_hash") != F.col("actual_hash"), "dirty")
    return joined.select("path", status.alias("status"), "expected_hash", "actual_hash").where(F.col("status").isNotNull())


def freshness(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state, by) of indexed files: fresh by metadata if size, time and
    mode agree, else fresh or stale by content hash; missing if gone."""
    c = current.select("path", *[F.col(x).alias(f"__{x}") for x in [*FAST, "hash"]])
    joined = indexed.join(c, "path", "left")
    same = (F.col("size") == F.col("__size")) & F.col("mtime_ms").eqNullSafe(F.col("__mtime_ms")) & F.col("mode").eqNullSafe(F.col("__mode"))
    there = F.col("__size").isNotNull()
    state = F.when(~there, "missing").when(same, "fresh").when(F.col("hash") == F.col("__hash"), "fresh").otherwise("stale")
    by = F.when(there & same, "metadata").when(there, "hash")
    return joined.select("path", state.alias("state"), by.alias("by"))


def added_files(indexed: DataFrame, current: DataFrame) -> DataFrame:
    return current.join(indexed.select("path"), "path", "left_anti")


def overlay_union(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """Files a search reads: unchanged ones from the index, changed and new ones
    live; deleted ones are gone.  One join and one row per path."""
    i = indexed.select("path", F.col("hash").alias("__hash"))
    joined = current.join(i, "path", "left")
    fresh = F.coalesce(F.col("hash") == F.col("__hash"), F.lit(False))
    reason = F.when(fresh, "index_fresh").when(F.col("__hash").isNull(), "added").otherwise("stale")
    return joined.withColumns({"source": F.when(fresh, "index").otherwise("overlay"), "reason": reason}).drop("__hash")


def proof_digest(files: DataFrame, digits: int | None = None) -> DataFrame:
    """One row: a digest of all (path, hash) pairs that doesn't depend on their
    order, and their number.  A tree over the hex digits of hashed paths: leaves
    hold the files that share ``digits`` of them, about 4096 unless given, every
    level above joins sixteen digests, so no list grows with the corpus."""
    if digits is None:
        digits = max(0, math.ceil(math.log(max(files.count(), 1) / 4096, 16)))
    level = files.select(F.substring(F.sha2("path", 256), 1, digits).alias("k"), F.concat_ws("=", "path", "hash").alias("d"), F.lit(1).cast("long").alias("n"))
    for length in range(digits, -1, -1):
        level = level.groupBy(F.substring("k", 1, length).alias("k")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("digest"), F.sum("n").alias("n"))
        level = level.select("k", F.concat_ws("=", "k", "digest").alias("d"), "digest", "n")
    return level.select("digest", F.col("n").alias("files"))


def store_is_fresh(stored: DataFrame, current: DataFrame) -> DataFrame:
    """One row: whether every stored file still has its content, and how many don't."""
    state = freshness(stored, current)
    return state.agg(F.coalesce(F.bool_and(F.col("state") == "fresh"), F.lit(True)).alias("fresh"), F.count_if(F.col("state") == "stale").alias("stale"), F.count_if(F.col("state") == "missing").alias("missing"))


#: Version of the stored tables; stores of another are rebuilt, not read.
SCHEMA_VERSION = 1


def store_verdict(meta: DataFrame, stored: DataFrame, current: DataFrame, snapshot_id: str, schema_version: int = SCHEMA_VERSION) -> DataFrame:
    """One row: whether a store may be used, and why not: its meta row
    (schema_version, snapshot_id) has another version or snapshot, or a stored file
    has changed or gone."""
    own = meta.agg(F.max("schema_version").alias("v"), F.max("snapshot_id").alias("s"))
    found = store_is_fresh(stored, current).crossJoin(own)  # one row each
    same_version, same_snapshot = F.col("v").eqNullSafe(F.lit(schema_version)), F.col("s").eqNullSafe(F.lit(snapshot_id))
    reason = F.when(~same_version, "schema_mismatch").when(~same_snapshot, "snapshot_mismatch").when(~F.col("fresh"), "files_changed")
    return found.select(reason.isNull().alias("usable"), reason.alias("reason"), "stale", "missing")


MANIFEST_HASHES = ["source_hash", "config_hash", "provider_hash", "environment_hash"]
BLOCKING = ["stale", "updating", "partial", "missing"]


def manifest_stale(manifest: DataFrame, current: DataFrame) -> DataFrame:
    keys = ["root_id", "language", "provider"]
    c = current.select(*keys, *[F.col(h).alias(f"__{h}") for h in MANIFEST_HASHES])
    differs = F.lit(False)
    for h in MANIFEST_HASHES:
        differs = differs | ~F.col(h).eqNullSafe(F.col(f"__{h}"))
    return manifest.join(c, keys, "left").select(*keys, differs.alias("stale"))


def next_manifest_state(state: Column, event: Column) -> Column:
    """State after a refresh event; events without a rule change nothing."""
    changed = event.isin("source_changed", "config_changed", "provider_env_changed")
    return F.when(changed, "stale").when((event == "periodic_reconcile") & (state == "stale"), "updating").otherwise(state)


def freshness_gate(manifests: DataFrame) -> DataFrame:
    """Per language: roots, those that block, and whether precise facts may be used."""
    blocks = F.col("state").isin(BLOCKING)
    return manifests.groupBy("language").agg(F.countDistinct("root_id").alias("roots"), F.countDistinct(F.when(blocks, F.col("root_id"))).alias("blocked"), F.bool_and(~blocks).alias("precise_allowed"))


# The legal steps of a provider's root.
TRANSITIONS = [
    ("missing", "starting"),
    ("starting", "importing"),
    ("importing", "ready"),
    ("ready", "resolving"),
    ("resolving", "ready"),
    ("ready", "stale"),
    ("stale", "resolving"),
    ("starting", "partial"),
    ("importing", "partial"),
    ("resolving", "partial"),
    ("partial", "retrying"),
    ("retrying", "ready"),
    ("retrying", "partial"),
]


def is_legal_step(state: Column, following: Column) -> Column:
    return F.concat_ws(">", state, following).isin([f"{a}>{b}" for a, b in TRANSITIONS])


def worst_state(states: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state of each key that stands last in ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("state"))
    return states.groupBy(*keys).agg(F.max_by("state", rank).alias("state"))


def label_remote(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Snapshots are verified where every file of theirs has the local hash."""
    l = local.select("path", F.col("hash").alias("__hash"))
    joined = remote.join(l, "path", "left")
    same = F.coalesce(F.col("hash") == F.col("__hash"), F.lit(False))
    return joined.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(~same).alias("unmatched"), F.when(F.bool_and(same), "verified").otherwise("unverified").alias("label"))
