"""One query per operator, over whole tables, and the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics.llm import audit, exact, html, licenses, mixing, negatives, neighbours, pieces, pii, quality, simhash, toxicity, warc
from modlytics.llm.common import documents
from modlytics.session import scratch_path
from modlytics.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    grouped = simhash.near_groups(documents(spark, folder, "doc_id", "text"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_labels(documents(spark, folder, "doc_id", "text"))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    sampled = pieces.segmentations(documents(spark, folder, "doc_id", "text"), ["doc_id"])
    return sampled.withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(documents(spark, folder, "doc_id", "text"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder, "doc_id", "source", "text"))


def op6_html(spark: SparkSession, folder: str) -> DataFrame:
    found = html.extracted(read_table(spark, folder, "pages", "page_id", "url", "html"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write_archive(read_table(spark, folder, "pages", "page_id", "url", "html"), path)
    columns = "page_id BIGINT, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_to BIGINT"
    return warc.read_archive(spark, path, columns)


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(documents(spark, folder, "doc_id", "text"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    base = F.sha2(joined(of(*pii.BASE_KINDS)).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, joined(F.col("spans")).alias("spans"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(documents(spark, folder, "doc_id", "text", "lang"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_table(spark, folder, "labels", "doc_id", "toxic")
    return toxicity.toxicity(documents(spark, folder, "doc_id", "text"), labels)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = negatives.vectors_of(read_table(spark, folder, "embeddings", "vec_id", "label", "embedding"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % negatives.ANCHOR_EVERY == 0)


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    failed = audit.failures(documents(spark, folder, "doc_id", "text", "lang"))
    return audit.audit(audit.with_labels(failed, read_table(spark, folder, "labels", "doc_id", "quality", "toxic")))


def op13_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings", "vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % neighbours.QUERY_EVERY == 0)


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_licenses": op2_licenses,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_html": op6_html,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_neighbours": op13_neighbours,
}
