"""Exact dedup, in DataFrame operations only.

Rows are grouped by a 128-bit content hash; inside a hash group the texts
themselves are the second grouping key, so bytes are compared and a hash
collision yields two groups, never one.  The text crosses the network once,
after map-side combining, and only digests take part in the join that returns
each row's group; that join can be split at a hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: whether the row with the "smallest" or the "largest" id of a group
    of byte-identical texts stays.  A null text counts as empty.  Rows that
    repeat an id and its text are one document: all of them are kept or dropped
    together, and each counts in group_size.  Null ids never win over others;
    a group with null ids only keeps those rows and has keep_id null.  An empty
    table gives an empty result; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    best = F.min if keep == "smallest" else F.max
    base = documents(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    content = F.unhex(F.md5("text"))
    groups = (
        base.groupBy(content.alias("hash"), "text")
        .agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
        .select("hash", F.sha2("text", 256).alias("text_sha256"), "group_size", "keep_id")
    )
    rows = base.select("doc_id", content.alias("hash"), F.sha2("text", 256).alias("text_sha256"))
    return rows.join(groups, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
