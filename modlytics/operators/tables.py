"""Next versions of the creator and comment tables.

A version goes to a new path, never over one being read. A bucketed comment table can also be changed
in place: only the buckets of the creators in question are read, written anew in the scratch folder,
and then put in place of the old ones. Where creators are scanned again and again, keep the tables by generation
(``generations``), so that a scan writes its own rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics.functions import dictionary as fixed
from modlytics.session import scratch_path
from modlytics.sources.tables import bucket_count, bucket_of, read_comments, write_comments, write_table

CREATOR_FIELDS = ["platform", "creator_name", "safety_score", "last_scanned"]


def with_defaults(scanned: DataFrame, ingest_time: str) -> DataFrame:
    """Scanned comments as they are stored: what is missing gets its default."""
    return scanned.withColumns(
        {
            "author": F.coalesce("author", F.lit(fixed.ANONYMOUS)),
            "text": F.coalesce("text", F.lit("")),
            "timestamp": F.coalesce("timestamp", F.lit(ingest_time)),
            "classification": F.coalesce("classification", F.lit(fixed.PROPER)),
            "severity_score": F.coalesce("severity_score", F.lit(0.0)),
            "flagged_words": F.coalesce("flagged_words", F.lit("")),
        }
    )


def replace_comments(
    stored: DataFrame, scanned: DataFrame, ingest_time: str, scanned_creators: DataFrame | None = None
) -> DataFrame:
    """All comments of every scanned creator replaced; creators with an empty scan keep theirs.

    Spark broadcasts the scanned keys only when it measures them small. Otherwise both sides are
    shuffled and the stored side of a hot creator may be split, since the keys are distinct. The keys
    come from ``scanned_creators`` where that table is at hand, else from the new comments.
    """
    replaced = scanned if scanned_creators is None else scanned_creators
    return delete_creators(stored, replaced).unionByName(with_defaults(scanned, ingest_time), allowMissingColumns=True)


def delete_creators(table: DataFrame, doomed: DataFrame) -> DataFrame:
    """A table keyed by creator without the listed creators; apply it to both tables."""
    return table.join(doomed.select("profile_url").distinct(), "profile_url", "left_anti")


def upsert_creators(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """Insert new creators and update known ones, which keep their first platform.

    A creator scanned more than once in a batch ends as its latest scan left it.
    """
    latest = (
        scanned.withColumn("safety_score", F.coalesce("safety_score", F.lit(fixed.EMPTY_SCORE)))
        .groupBy("profile_url")
        .agg(F.max(F.struct("last_scanned", "creator_name", "safety_score", "platform")).alias("new"))
    )
    old = stored.select("profile_url", F.struct(*CREATOR_FIELDS).alias("old"))
    return old.join(latest, "profile_url", "full_outer").select(
        "profile_url",
        F.coalesce("old.platform", "new.platform").alias("platform"),
        *[F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in CREATOR_FIELDS[1:]],
    )


def write_scores(creators: DataFrame, scores: DataFrame) -> DataFrame:
    """Recomputed scores onto their creators; the others keep theirs."""
    new = scores.select("profile_url", F.col("safety_score").alias("_new"))
    return (
        creators.join(new, "profile_url", "left")
        .withColumn("safety_score", F.coalesce("_new", "safety_score"))
        .drop("_new")
    )


def _touched(stored: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
    """The stored comments of the keys' buckets. Bucket numbers reach the driver, at most ``buckets``."""
    found = keys.select(bucket_of(F.col("profile_url"), buckets).alias("b")).distinct().collect()
    return stored.filter(F.col("bucket").isin([r["b"] for r in found]))


def _put(spark: SparkSession, path: str, comments: DataFrame, touched: DataFrame, buckets: int) -> DataFrame:
    """Replaces the touched buckets; one that is left empty is deleted, last, so a repeated call ends the same."""
    written = write_table(comments.drop("buckets", "bucket"), scratch_path(spark, "touched"))
    gone = touched.select("bucket").distinct().join(
        written.select(bucket_of(F.col("profile_url"), buckets).alias("bucket")).distinct(), "bucket", "left_anti"
    )
    emptied = [r["bucket"] for r in gone.collect()]
    table = write_comments(written, path, buckets, replace=True)
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket in emptied:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/buckets={buckets}/bucket={bucket}"), True)
    return read_comments(spark, path) if emptied else table


def replace_in_table(
    spark: SparkSession, path: str, scanned: DataFrame, ingest_time: str, scanned_creators: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """replace_comments on a bucketed table at ``path``: other creators' buckets are neither read nor written. The number of
    buckets is the table's; one that is given and isn't is an error."""
    keys = scanned if scanned_creators is None else scanned_creators
    stored = read_comments(spark, path)
    number = bucket_count(stored, buckets)
    touched = _touched(stored, keys, number)
    left = replace_comments(touched.drop("buckets", "bucket"), scanned, ingest_time, scanned_creators)
    return _put(spark, path, left, touched, number)


def delete_from_table(spark: SparkSession, path: str, doomed: DataFrame, buckets: int | None = None) -> DataFrame:
    """delete_creators on a bucketed comment table at ``path``."""
    stored = read_comments(spark, path)
    number = bucket_count(stored, buckets)
    touched = _touched(stored, doomed, number)
    return _put(spark, path, delete_creators(touched, doomed), touched, number)
