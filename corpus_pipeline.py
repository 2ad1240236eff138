"""Corpus pipeline: documents through five stages, each written and read again.

Every stage works on all rows its predecessor kept.  The stages before the last
return the columns of ``documents``; the last returns the packed pieces.

A row is known by its id and its text, so rows that share an id, or have none, are
never mixed up or multiplied:

* quality: a row goes if its own text is rejected;
* exact dedup: of rows with equal texts one stays, one with the smallest id;
* near-dedup: of each group one row stays, one with the smallest id and of those
  the one whose text has the smallest digest;
* substring dedup and packing keep every row.

Null and empty texts are texts like any other; null ids are larger than all
others.  Ties are settled as above.  Texts of any length pass whole.  An empty
table passes every stage as an empty table.  Columns besides those of documents
are dropped, whatever they are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ensure_checkpoint_dir, remove_folder, split_join
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.packing import best_fit_packing
from tessera.llm.quality import quality_scores
from tessera.llm.queries import vocabulary_path
from tessera.llm.simhash import simhash_similar
from tessera.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What makes two rows one: the id, its absence, a digest of the text.
ROW = ["__id", "__none", "__digest"]


def _keyed(rows: DataFrame, digest: Column) -> DataFrame:
    return rows.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__none": F.col("doc_id").isNull(), "__digest": F.unhex(digest)})


def _keep(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The documents that are among the rows of ``judged`` (doc_id, text_md5)."""
    wanted = _keyed(judged, F.col("text_md5")).select(*ROW).distinct()
    rows = _keyed(docs.select(*COLUMNS), F.md5(F.coalesce("text", F.lit(""))))
    return split_join(rows, wanted, ROW, "left_semi").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _keep(docs, quality_scores(docs, labels, threshold=0.3).where("predicted = 1"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, with the smallest id, of each group of equal texts."""
    wanted = _keyed(exact_dedup(docs, keep="smallest").where("kept"), F.col("text_sha256")).select(*ROW).distinct()
    rows = _keyed(docs.select(*COLUMNS), F.sha2(F.coalesce("text", F.lit("")), 256))
    # rows that repeat an id and its text become one before they meet, so no key is hot
    rows = rows.groupBy(*ROW).agg(*(F.first(c).alias(c) for c in COLUMNS))
    return rows.join(wanted, ROW, "left_semi").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: texts that SimHash fingerprints or
    MinHash bands bring together, linked at a Jaccard similarity of 0.8 or more of
    their five-word shingles."""
    return _keep(docs, simhash_similar(docs, shingle=5, similarity=0.8).where("first"))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; other texts stay as they are."""
    found = substring_dedup(docs, window=13, carry=["lang", "source"], as_is=True)
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return best_fit_packing(docs, vocabulary_path(), capacity=2048, with_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("substring dedup", substring),
    ("best-fit packing", packing),
]

#: The classifier and the packing can't be written in SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents.  Each but the last is written below the
    shared checkpoint folder and read again, which also cuts its lineage; what a
    later stage has been written from is removed."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
            if number:
                remove_folder(spark, f"{folder}/{number - 1}")
    return docs
