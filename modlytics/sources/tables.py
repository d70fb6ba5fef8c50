"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a parquet table; no others reach the scan."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return table.select(*columns) if columns else table


def stream_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A parquet table as a stream of its files, whether it is one file or a folder of them.

    The pattern matches the one name only. As a plain path, a single file would be taken for the folder of
    a partitioned table, which is an error.
    """
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def write_table(table: DataFrame, path: str, *cluster_by: str) -> DataFrame:
    """Write a table version to a new path and read it back.

    Rows are ordered inside each output file, without a shuffle, so that the row-group statistics of
    the clustering columns let a filter on them skip most of a file.
    """
    ordered = table.sortWithinPartitions(*cluster_by) if cluster_by else table
    ordered.write.mode("errorifexists").parquet(path)
    return table.sparkSession.read.parquet(path)


#: Partition directories of a comment table, if nothing else is said. A creator's comments are in one of them.
BUCKETS = 64


def bucket_of(profile_url: Column, buckets: int | Column = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(profile_url), F.lit(buckets)).cast("int")


def write_comments(comments: DataFrame, path: str, buckets: int = BUCKETS, *, replace: bool = False) -> DataFrame:
    """Write comments by bucket of their creator, ordered inside by creator and time, and read them back.

    The number of buckets is part of the folders' names (``buckets=n/bucket=b``), so a reader takes it from the table.
    A bucket with a hot creator is split over several tasks and files, small ones are put together.
    ``replace`` puts the buckets that occur in ``comments`` in place of those in the table at ``path``;
    the others are not touched.
    """
    placed = {"buckets": F.lit(buckets), "bucket": bucket_of(F.col("profile_url"), buckets)}
    bucketed = comments.withColumns(placed).hint("rebalance", "bucket")
    ordered = bucketed.sortWithinPartitions("bucket", "profile_url", F.desc("timestamp"))
    writer = ordered.write.partitionBy("buckets", "bucket")
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("errorifexists").parquet(path)
    return read_comments(comments.sparkSession, path)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def bucket_count(stored: DataFrame, expected: int | None = None) -> int:
    """The number of buckets that a comment table was written with; an error if another one is expected."""
    first = stored.select("buckets").first()
    found = first["buckets"] if first else expected or BUCKETS
    if expected is not None and expected != found:
        raise ValueError(f"the table has {found} buckets, not {expected}")
    return found
