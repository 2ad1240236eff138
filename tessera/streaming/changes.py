"""Change tracking on streams of file events.

Events carry a sequence number, because order within a micro-batch is not
given.  The watermark is this engine's choice; late events beyond it are lost
to windows but not to the fold, whose state is kept per path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.paths import is_skipped
from tessera.operators.lineage import remove
from tessera.operators.snapshots import reconcile

EVENTS = "path string, seq long, ts timestamp, kind string, previous_path string"
CHANGES = "path string, change string, previous_path string, events long"
_STATE = "change string, previous_path string, events long"


def _next(change: str | None, kind: str) -> str | None:
    if kind == "rename":
        return "renamed"
    if change is None:
        return {"create": "added", "rename_to": "added", "modify": "modified", "metadata": "modified", "rename_from": "renamed", "remove": "deleted"}.get(kind)
    if change == "added":
        return {"modify": "modified", "remove": None}.get(kind, change)
    return change


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    change, previous, count = state.get if state.exists else (None, None, 0)
    rows = pd.concat(list(batches)).sort_values("seq")
    for kind, old in zip(rows["kind"], rows["previous_path"]):
        change = _next(change, kind)
        previous = old if kind == "rename" else None if change is None else previous
        count += 1
    state.update((change, previous, int(count)))
    yield pd.DataFrame({"path": [key[0]], "change": [change], "previous_path": [previous], "events": [count]})


def fold_stream(events: DataFrame) -> DataFrame:
    """Running fold per path; each micro-batch emits the new state of the paths it
    touched, a null change meaning that the changes cancel.  Update mode."""
    kept = events.where(~is_skipped(F.col("path")))
    return kept.groupBy("path").applyInPandasWithState(_fold, CHANGES, _STATE, "update", GroupStateTimeout.NoTimeout)


def tumbling_stream(events: DataFrame, window: str, late: str) -> DataFrame:
    """Events per fixed window and kind; append mode emits a window once it is closed."""
    kept = events.where(~is_skipped(F.col("path"))).withWatermark("ts", late)
    return kept.groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("window_start"), "kind", "events")


class Overlay:
    """Differences between a stored snapshot and the live catalog, replaced by each
    micro-batch and read as a table.  Every state is a new folder; the newest that
    was written to its end counts, so a reader never meets half a state."""

    SCHEMA = "path string, status string, expected_hash string, actual_hash string"

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _versions(self, spark) -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        numbers = [s.getPath().getName() for s in fs.listStatus(path)]
        done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))
        return sorted(int(n) for n in numbers if n.isdigit() and done(n))

    def _write(self, state: DataFrame) -> None:
        spark = state.sparkSession
        versions = self._versions(spark)
        state.write.mode("overwrite").parquet(f"{self.folder}/{(versions[-1] if versions else 0) + 1}")
        for old in versions[:-1]:  # the one before stays for those who read it now
            remove(spark, f"{self.folder}/{old}")

    def replace(self, snapshot: DataFrame, current: DataFrame) -> None:
        self._write(reconcile(snapshot, current))

    def read(self, spark) -> DataFrame:
        versions = self._versions(spark)
        return spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/{versions[-1]}") if versions else spark.createDataFrame([], self.SCHEMA)

    def clear(self, spark) -> None:
        self._write(spark.createDataFrame([], self.SCHEMA))

    def follow(self, catalog_stream: DataFrame, snapshot: DataFrame, checkpoint: str):
        """Start a query that reconciles each batch of catalog rows."""
        return catalog_stream.writeStream.foreachBatch(lambda batch, _: self.replace(snapshot, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_index(events: DataFrame, index, snapshot: str, checkpoint: str):
    """Start a query that brings an index up to date for each micro-batch of events
    (path, ...) outside ignored directories; metadata decide what is read again."""

    def refresh(batch: DataFrame, _: int) -> None:
        if not batch.where(~is_skipped(F.col("path"))).isEmpty():
            index.update(snapshot)

    return events.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
