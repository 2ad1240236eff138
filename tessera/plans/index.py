"""Life of an index: build, update if stale, status, verify, doctor, clean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import snapshots
from tessera.operators.lineage import cut
from tessera.operators.parser import extract_facts
from tessera.plans.stored import TABLES, StoredFacts
from tessera.plans.verbs import Engine
from tessera.sources.catalog import Workspace, included, list_tree, scan_tree, skipped, with_proofs
from tessera.sources.store import SnapshotStore

EXIT_OK, EXIT_NO_MATCH, EXIT_NOT_VERIFIED = 0, 2, 6
#: Changed paths that a reader is given as a list.
MOST_PATHS = 5_000


@dataclass
class Index:
    spark: SparkSession
    store: SnapshotStore
    root: str

    def _live(self, only: list[str] | None = None) -> DataFrame:
        return with_proofs(included(scan_tree(self.spark, self.root, only=only))).withColumn("mode", F.lit(None).cast("long"))

    def facts(self, snapshot: str) -> StoredFacts:
        return StoredFacts(self.store, snapshot)

    def snapshot_id(self) -> str:
        return Workspace.discover(self.root).snapshot_id

    def build(self) -> str:
        """Write catalog, postings, occurrences and symbols, parser facts, and
        contents with their proofs."""
        snapshot = self.snapshot_id()
        live = self._live()
        self.store.write("proofs", snapshot, live.select("path", "hash", "line_offsets", "content"), sort=["path"])
        self.store.write("parser_facts", snapshot, extract_facts(live), sort=["name", "path"])
        self.facts(snapshot).build(live)
        return snapshot

    def changed(self, snapshot: str) -> DataFrame:
        """(path, status) of files that are new, gone, or differ in size or time; no
        content is read."""
        stored = self.store.read("catalog", snapshot).select("path", F.col("size").alias("__size"), F.col("mtime_ms").alias("__time"))
        joined = stored.join(list_tree(self.spark, self.root), "path", "full")
        same = (F.col("size") == F.col("__size")) & (F.col("mtime_ms") == F.col("__time"))
        status = F.when(F.col("__size").isNull(), "added").when(F.col("size").isNull(), "deleted").when(~same, "touched")
        return joined.select("path", status.alias("status")).where(F.col("status").isNotNull())

    def status(self, snapshot: str) -> DataFrame:
        return snapshots.store_is_fresh(self.store.read("catalog", snapshot), self.current(snapshot))

    def current(self, snapshot: str) -> DataFrame:
        """Files as they are now, with hash and content: those that no metadata
        speak against from the store, only the others read from the tree."""
        changed = cut(self.changed(snapshot))
        kept = self.store.read("catalog", snapshot).join(changed.select("path"), "path", "left_anti")
        kept = kept.join(self.store.read("proofs", snapshot).select("path", "line_offsets", "content"), "path")
        columns = ["path", "language", "size", "mtime_ms", "mode", "hash", "line_offsets", "content"]
        # a list for the reader as long as it is short; beyond that the tree is scanned and joined
        paths = [r.path for r in changed.where("status <> 'deleted'").limit(MOST_PATHS + 1).collect()]
        live = self._live(paths if len(paths) <= MOST_PATHS else None)
        live = live if len(paths) <= MOST_PATHS else live.join(changed.select("path"), "path", "left_semi")
        return kept.select(*columns).unionByName(live.select(*columns))

    def update(self, snapshot: str) -> bool:
        """Rebuild if any file changed, came or went; whether it did."""
        if snapshots.reconcile(self.store.read("catalog", snapshot), self.current(snapshot)).isEmpty():
            return False
        self.build()
        return True

    def verify(self, snapshot: str) -> int:
        return EXIT_OK if self.status(snapshot).first()["fresh"] else EXIT_NOT_VERIFIED

    def doctor(self, snapshot: str) -> dict[str, bool]:
        """Whether each table of a snapshot is there."""
        return {table: self.store.has(table, snapshot) for table in (*TABLES, "proofs", "parser_facts")}

    def clean(self, snapshot: str) -> None:
        """Drop all tables of a snapshot."""
        for table in (*TABLES, "proofs", "parser_facts"):
            self.store.drop(table, snapshot)

    def skipped(self) -> DataFrame:
        return skipped(scan_tree(self.spark, self.root))

    def engine(self, snapshot: str) -> Engine:
        """Search over the index where it is fresh and over the live tree elsewhere;
        postings narrow the former."""
        indexed = Engine(self.store.read("catalog", snapshot), snapshot, self.facts(snapshot).grams(), fold_case=True)
        return indexed.over(self.current(snapshot))
