"""Scheduling of semantic probes, capability states, saved queries and paging of diffs."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Probe priorities, most urgent first.
PRIORITIES = ["current_query", "changed_file", "open_file", "recent_query", "background", "idle"]
PER_ROOT, PER_FILE = 50_000, 2_000


def schedule(probes: DataFrame, batch: int, roots_per_provider: int) -> DataFrame:
    """probes (root_id, provider, file, symbol, priority): repeats keep the most
    urgent; each provider serves its first roots, each root its first ``batch``
    probes; the rest is deferred.  (…, status)."""
    one = probes.groupBy("root_id", "provider", "file", "symbol").agg(F.min("priority").alias("priority"))
    roots = one.select("provider", "root_id").distinct()
    # ranks of roots need one row a root, not one a probe
    admitted = roots.withColumn("root_rank", F.row_number().over(Window.partitionBy("provider").orderBy("root_id")))
    n = F.row_number().over(Window.partitionBy("provider", "root_id").orderBy("priority", "file", "symbol"))
    joined = one.withColumn("n", n).join(admitted, ["provider", "root_id"])
    status = F.when(F.col("root_rank") > roots_per_provider, "deferred_root").when(F.col("n") > batch, "deferred_batch").otherwise("scheduled")
    return joined.select("provider", "root_id", "file", "symbol", "priority", status.alias("status"))


def cap_candidates(candidates: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` candidates of each key, with a flag where some were cut."""
    w = Window.partitionBy(key)
    # one row more than asked tells whether some were cut; the rank limit is applied before the shuffle
    kept = candidates.withColumn("__n", F.row_number().over(w.orderBy(*order))).where(F.col("__n") <= most + 1)
    flagged = kept.withColumn("truncated", F.max("__n").over(w) > most)
    return flagged.where(F.col("__n") <= most).drop("__n")


def capability_state(capabilities: DataFrame) -> DataFrame:
    """(language, state, features): blocked if any feature blocks, partial if any is partial."""
    return capabilities.groupBy("language").agg(
        F.when(F.bool_or("blocks"), "blocked").when(F.bool_or(F.col("level") == "partial"), "partial").otherwise("ready").alias("state"),
        F.countDistinct("feature").alias("features"),
    )


def page_hunks(hunks: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of diff hunks in order, each row with has_more."""
    total = hunks.agg(F.count(F.lit(1)).alias("total"))
    rows = hunks.orderBy("path", "hunk").offset(offset).limit(limit)
    return rows.crossJoin(total).withColumn("has_more", F.col("total") > offset + limit).drop("total")  # the total is one row


class SavedQueries:
    """Named queries as JSON files of a folder, on the driver."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def _file(self, name: str) -> Path:
        if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.-]*", name):
            raise ValueError(f"invalid query name: {name!r}")
        return self.folder / f"{name}.json"

    def save(self, name: str, verb: str, arguments: dict, snapshot_id: str, cursor: str | None = None) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        self._file(name).write_text(json.dumps({"verb": verb, "arguments": arguments, "snapshot_id": snapshot_id, "cursor": cursor}, sort_keys=True))

    def show(self, name: str) -> dict:
        return json.loads(self._file(name).read_text())

    def list(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json")) if self.folder.exists() else []

    def delete(self, name: str) -> bool:
        there = self._file(name).exists()
        self._file(name).unlink(missing_ok=True)
        return there

    def replay(self, name: str, snapshot_id: str) -> tuple[str, dict, str | None]:
        """(verb, arguments, cursor); the cursor only holds for its own snapshot."""
        saved = self.show(name)
        return saved["verb"], saved["arguments"], saved["cursor"] if saved["snapshot_id"] == snapshot_id else None

    def run(self, name: str, engine, snapshot_id: str):
        """The answer of the saved verb of an engine, from the saved page on if the
        snapshot is still the same."""
        verb, arguments, cursor = self.replay(name, snapshot_id)
        if verb.startswith("_") or not callable(getattr(engine, verb, None)):
            raise ValueError(f"unknown verb: {verb!r}")
        return getattr(engine, verb)(**arguments, **({"cursor": cursor} if cursor else {}))
