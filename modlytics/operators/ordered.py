"""Comments in one order per creator, and pages of it.

All comments are cut into ranges by (creator, order), one sorted file each, with bounds that Spark samples; so a creator with a
large share of all comments is several files that follow one another. A fence table says, for each creator and file, how
many of the creator's rows the file has and between which values. A page then opens the one or two files that hold it,
and a position is the rows in the files before and the place in the file.

Defined cases: rows without a creator are left out; ties go by comment id; null times and severities come last; a page past the
end is empty; a key that no comment has is a place like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The column that decides, greatest first; then the comment id.
ORDERS = {"newest": "timestamp", "gravest": "severity_score"}
ROWS, FENCES = "rows", "fences"


def _order(order: str) -> list[Column]:
    return [F.desc_nulls_last(ORDERS[order]), F.asc("comment_id")]


def write_ordered(comments: DataFrame, path: str, order: str = "newest", files: int | None = None) -> None:
    """Writes comments in an order to a new path. ``files`` is about how many there are; if not given, Spark sizes them."""
    known = comments.filter("profile_url is not null")
    by = [F.asc("profile_url"), *_order(order)]
    ranged = known.repartitionByRange(files, *by) if files else known.repartitionByRange(*by)
    # The place among all rows: the partition above, the row below.
    placed = ranged.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(f"{path}/{ROWS}")
    spark = comments.sparkSession
    value = ORDERS[order]
    written = spark.read.parquet(f"{path}/{ROWS}").select("profile_url", value, "_at", F.col("_metadata.file_name").alias("file"))
    held = written.groupBy("profile_url", "file").agg(
        F.count(F.lit(1)).alias("rows"), F.min("_at").alias("first"), F.max(value).alias("most"), F.min(value).alias("least"),
        (F.count(value) < F.count(F.lit(1))).alias("has_null"),
    )
    before = Window.partitionBy("profile_url").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    # One row per creator and file, so a creator with many files still has few rows.
    fenced = held.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    fenced.repartitionByRange("profile_url", "first").sortWithinPartitions("profile_url", "first").write.parquet(f"{path}/{FENCES}")


def fences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{FENCES}")


def _open(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{ROWS}")
    return spark.read.schema(rows.schema).parquet(*[f"{path}/{ROWS}/{f}" for f in files]) if files else rows.limit(0)


def numbered(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """All comments with their place in their creator's order, from 0."""
    starts = fences(spark, path).select(
        F.col("profile_url").alias("_url"), F.col("file").alias("_file"), (F.col("before") - F.col("first")).alias("_start")
    )
    rows = spark.read.parquet(f"{path}/{ROWS}").withColumn("_held", F.col("_metadata.file_name"))
    met = rows.join(starts, (F.col("profile_url") == F.col("_url")) & (F.col("_held") == F.col("_file")))
    return met.withColumn(name, F.col("_at") + F.col("_start")).drop("_url", "_file", "_start", "_held", "_at")


def page(
    spark: SparkSession, path: str, profile_url: str, size: int, after: tuple | None = None, order: str = "newest"
) -> DataFrame:
    """The ``size`` comments of a creator that come next after a key (value of the order, comment id), or the first ones.

    The creator's fences reach the driver, one per file.
    """
    held = fences(spark, path).filter(F.col("profile_url") == profile_url).orderBy("first").collect()
    own = F.col("profile_url") == profile_url
    value = F.col(ORDERS[order])
    if after is not None:
        last, comment_id = after
        if last is None:
            own &= value.isNull() & (F.col("comment_id") > comment_id)
            held = [f for f in held if f["has_null"]]
        else:
            own &= (value < last) | value.isNull() | ((value == last) & (F.col("comment_id") > comment_id))
            held = [f for f in held if f["has_null"] or f["least"] <= last]
    files: list[str] = []
    sure = 0
    for fence in held:
        if sure >= size:
            break
        # Of the first file some rows may be before the key; all of the others are after it.
        whole = after is None or after[0] is not None and not fence["has_null"] and fence["most"] < after[0]
        sure += fence["rows"] if whole else 0
        files.append(fence["file"])
    rows = _open(spark, path, files).filter(own)
    return rows.orderBy(*_order(order)).limit(size).drop("_at")


def in_order(spark: SparkSession, path: str, profile_url: str) -> DataFrame:
    """All comments of one creator, in order; other creators' files are not opened."""
    files = [f["file"] for f in fences(spark, path).filter(F.col("profile_url") == profile_url).collect()]
    return _open(spark, path, files).filter(F.col("profile_url") == profile_url).orderBy("_at").drop("_at")
