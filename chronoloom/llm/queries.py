"""The operators applied to the provided tables, with equal SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import bisectors, html, jaccard, langid, packing, postings, quality, secrets, substrings, toxicity, tries, urls, warc
from chronoloom.llm.common import table
from chronoloom.llm.sql import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.judge(quality.ledger(table(spark, sf_dir, "documents")))
    entries = quality.judge(entries, quality.BASE, "base_kept")
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept"
    )


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


@query
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "net")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    book = langid.train(docs.where(~out), "true")
    return langid.predict(docs, book).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.capture_histories(table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "range", "place")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.deduplicate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bisectors.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = "coalesce(pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0, false)"
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), f"NOT {held_out}")
    return toxicity.score(docs, net).select("doc_id", F.expr(held_out).alias("held_out"), "score", "predicted")


@query
def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_nodes(table(spark, sf_dir, "conversations"))
