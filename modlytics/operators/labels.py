"""Labels from an outside source: batches out, labels in, rules as fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.functions import dictionary as fixed
from modlytics.functions.payloads import whole_json
from modlytics.functions.rules import bind
from modlytics.functions.text import split_triggers
from modlytics.operators.moderation import moderate
from modlytics.session import scratch_path
from modlytics.sources.tables import write_table

BATCH = ["profile_url", "batch_id"]
ITEM = [*BATCH, "id"]


def cut_batches(comments: DataFrame, rows_per_batch: int = fixed.LABEL_BATCH_ROWS) -> DataFrame:
    """Batch number and number inside the batch from the position in the creator's scan; no shuffle."""
    return comments.withColumns(
        {
            "batch_id": F.expr(f"pos div {rows_per_batch}"),
            "id": F.col("pos") % rows_per_batch,
        }
    )


def label_payloads(batched: DataFrame) -> DataFrame:
    """One JSON array of {id, text} per batch. A group holds one batch, never a whole creator."""
    items = F.array_sort(F.collect_list(F.struct("id", "text")))
    return batched.groupBy(*BATCH).agg(F.to_json(items).alias("payload"), F.count(F.lit(1)).alias("items"))


def parse_label_payloads(landed: DataFrame, *keep: str) -> DataFrame:
    """(profile_url, batch_id, payload) -> (profile_url, batch_id, keep..., ok, labels).

    ``labels`` keeps the items in payload order. A payload is not ok when it is missing or broken, is
    no array, has an item without an id, or gives a severity that is no number.
    """
    items = bind(
        whole_json(F.col("payload")),
        lambda tree: F.when(
            F.startswith(F.schema_of_variant(tree), F.lit("ARRAY")), F.try_variant_get(tree, "$", "array<variant>")
        ),
    )
    return (
        landed.withColumn("items", items)
        .withColumn("labels", F.transform("items", _label))
        .select(*BATCH, *keep, F.coalesce(F.forall("labels", lambda x: x["valid"]), F.lit(False)).alias("ok"), "labels")
    )


def _label(item: Column) -> Column:
    key = F.try_variant_get(item, "$.id", "variant")
    given = F.try_variant_get(item, "$.severity_score", "variant")
    number = F.try_variant_get(item, "$.severity_score", "double")
    # An id in quotes is text and names no comment, as it would not equal a number.
    number_id = F.when(F.schema_of_variant(key) != "STRING", F.try_variant_get(item, "$.id", "bigint"))
    return F.struct(
        number_id.alias("id"),
        F.try_variant_get(item, "$.classification", "string").alias("classification"),
        number.alias("severity_score"),
        F.try_variant_get(item, "$.flagged_words", "string").alias("flagged_words"),
        (key.isNotNull() & (given.isNull() | number.isNotNull())).alias("valid"),
    )


def label_rows(parsed: DataFrame) -> DataFrame:
    """Parsed payloads that are ok as rows: batch keys, id, item number and the label fields."""
    fields = [F.col(f"label.{c}").alias(c) for c in ("id", "classification", "severity_score", "flagged_words")]
    given = F.posexplode_outer(F.when(F.col("ok"), F.col("labels"))).alias("item", "label")
    return parsed.select(*BATCH, given).filter(F.col("item").isNotNull()).select(*BATCH, "item", *fields)


def last_labels(labels: DataFrame) -> DataFrame:
    """One label per id of a batch; of several the last one counts."""
    kept = F.max_by(F.struct("classification", "severity_score", "flagged_words"), F.col("item"))
    return labels.filter(F.col("id").isNotNull()).groupBy(*ITEM).agg(kept.alias("label")).select(*ITEM, "label.*")


def _with_defaults(classification: Column, severity: Column, flagged: Column) -> list[Column]:
    return [
        F.coalesce(classification, F.lit(fixed.PROPER)).alias("classification"),
        F.coalesce(severity, F.lit(0.0)).alias("severity_score"),
        F.coalesce(flagged, F.lit("")).alias("flagged_words"),
    ]


def merge_labels(batched: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels onto comments by batch and id; a comment without one is proper.

    The keys hold one comment each, so no creator is hot in this join.
    """
    own = [c for c in batched.columns if c not in ITEM]
    return batched.join(last_labels(labels), ITEM, "left").select(
        *ITEM, *own, *_with_defaults(F.col("classification"), F.col("severity_score"), F.col("flagged_words"))
    )


def batch_records(batched: DataFrame, parsed: DataFrame) -> DataFrame:
    """(profile_url, batch_id, ok, labels) of each expected batch, written once."""
    expected = batched.select(*BATCH).distinct()
    records = expected.join(parsed, BATCH, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return write_table(records, scratch_path(batched.sparkSession, "batches"))


def hybrid_labels(batched: DataFrame, parsed: DataFrame) -> DataFrame:
    """Outside labels where a creator's whole scan has them, the rules everywhere else.

    ``parsed`` is what parse_label_payloads gives. The records of the batches are written once, so
    payloads are parsed once, and comments are read for the batches and for the labels. One failed or
    missing batch sends its creator to the rules: one flag per creator, counted before the shuffle.

    Comments meet the record of their batch, so a key holds one batch of comments; the label is then
    looked up in the record by id. The rules run only for comments that need them.
    """
    records = batch_records(batched, parsed)
    return label_by_verdict(batched, records, records.groupBy("profile_url").agg(F.bool_and("ok").alias("scan_ok")))


def label_by_verdict(batched: DataFrame, records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """hybrid_labels where (profile_url, scan_ok) is known: outside labels for the creators that are ok, the rules for all others."""
    verdicts = records.join(verdicts, "profile_url").select(*BATCH, "scan_ok", "labels")
    joined = batched.join(verdicts, BATCH, "left").withColumn(
        "label", F.try_element_at(F.filter("labels", lambda x: x["id"] == F.col("id")), F.lit(-1))
    )
    scan_ok = F.coalesce("scan_ok", F.lit(False))
    given = _with_defaults(
        F.col("label.classification"), F.col("label.severity_score"), F.col("label.flagged_words")
    )
    outside = F.struct(*given[:2], split_triggers(F.col("_flagged")).alias("triggers"))
    known = joined.withColumns({"scan_ok": scan_ok, "_flagged": given[2]})
    labelled = moderate(known, F.when(F.col("scan_ok"), outside))
    return labelled.withColumn(
        "flagged_words", F.when(F.col("scan_ok"), F.col("_flagged")).otherwise(F.col("flagged_words"))
    ).drop("labels", "label", "_flagged")
