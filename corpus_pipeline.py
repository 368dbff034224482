"""From raw documents to packed training sequences: each stage applies one operator to what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import jaccard, packing, postings, quality, secrets
from chronoloom.llm.common import small_batches, table
from chronoloom.session import durable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of similar ones."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item; each row is judged by itself, whatever its id."""
    small_batches(spark)
    rows = durable(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("doc_id")))
    found = postings.decontaminate(rows.select("doc_id", "row.text"), table(spark, sf_dir, "benchmark"))
    hit = durable(found.where("n_hit > 0").select("doc_id"))
    return rows.join(hit, "doc_id", "left_anti").select("row.*")


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    small_batches(spark)
    net = secrets.train(durable(secrets.scan(docs)))
    return secrets.mask_documents(docs, net)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 4096 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_masking),
    ("packing", packing_stage),
]

#: SQL can express neither the trained network nor the tokenizer: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
