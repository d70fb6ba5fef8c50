"""CSV exports and reading them back.

A folder per creator suits some hundred creators with links that fit a folder's name (about 250 characters when encoded). A
pack suits any number of creators and links of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics import schemas

# Quotes are doubled inside quotes, blanks at either end are kept, and an empty text is an empty field.
DIALECT = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


#: The partition column of an export: one folder per creator.
CREATOR = "creator"


def _write(rows: DataFrame, path: str) -> None:
    rows.write.options(**DIALECT, emptyValue="", nullValue="").partitionBy(CREATOR).csv(path)


def export_comments(comments: DataFrame, path: str) -> None:
    """One folder of files per creator, each with the usual header and columns."""
    _write(comments.select(F.col("profile_url").alias(CREATOR), *schemas.EXPORT_COLUMNS), path)


def export_blocklist(blocklist: DataFrame, path: str) -> None:
    """One folder per creator with one column of handles."""
    _write(blocklist.select(F.col("profile_url").alias(CREATOR), F.col("author").alias("Username")).distinct(), path)


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An export of all creators read back, with the creator; an empty field is an empty text again."""
    return spark.read.schema(f"{schema}, {CREATOR} STRING").options(**DIALECT, multiLine="true").csv(path).na.fill("")


def read_export_of(spark: SparkSession, path: str, schema: str, profile_url: str) -> DataFrame:
    """One creator's export; no other folder is opened."""
    return read_export(spark, path, schema).filter(F.col(CREATOR) == profile_url).drop(CREATOR)


# --- packed exports: any number of creators, links of any length ---

#: Where a pack has its CSV files and its list of them.
ROWS, MANIFEST = "rows", "manifest"


def pack(rows: DataFrame, path: str, order: list[Column], columns: list[Column | str]) -> None:
    """Rows with a ``creator`` as CSV files that hold many creators each, and which creator is in which of them.

    Rows are cut into ranges by creator and ``order``, a file each, sized by Spark; a creator with very many rows is several
    files that follow one another. No path holds a link. Rows without a creator are left out, as nobody could ask for them.
    """
    ranged = rows.filter(F.col(CREATOR).isNotNull()).repartitionByRange(CREATOR, *order).sortWithinPartitions(CREATOR, *order)
    spark = rows.sparkSession
    ranged.select(CREATOR, *columns).write.options(**DIALECT, emptyValue="", nullValue="").csv(f"{path}/{ROWS}")
    written = _rows(spark, path, None, f"{CREATOR} STRING")
    listed = written.groupBy(F.col(CREATOR), F.col("file")).agg(F.count(F.lit(1)).alias("rows"))
    listed.repartitionByRange(CREATOR, "file").sortWithinPartitions(CREATOR, "file").write.parquet(f"{path}/{MANIFEST}")


def _rows(spark: SparkSession, path: str, files: list[str] | None, schema: str) -> DataFrame:
    """Rows of a pack's files, or of all of them, with their file. An empty field is an empty text again."""
    reader = spark.read.schema(schema).options(**DIALECT, multiLine="true", enforceSchema="true")
    if files == []:
        return spark.createDataFrame([], f"{schema}, file STRING")
    where = f"{path}/{ROWS}" if files is None else [f"{path}/{ROWS}/{f}" for f in files]
    return reader.csv(where).select(F.col("_metadata.file_name").alias("file"), "*").na.fill("")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(creator, file, rows) of a pack."""
    return spark.read.schema(f"{CREATOR} STRING, file STRING, rows BIGINT").parquet(f"{path}/{MANIFEST}")


def read_pack(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a pack, with their creator."""
    return _rows(spark, path, None, f"{CREATOR} STRING, {schema}").drop("file")


def read_pack_of(spark: SparkSession, path: str, schema: str, profile_url: str) -> DataFrame:
    """One creator's rows in their order; only the files that the manifest names are opened.

    The names of one creator's files reach the driver. They follow one another, and so do the rows in each.
    """
    files = [r["file"] for r in manifest(spark, path).filter(F.col(CREATOR) == profile_url).orderBy("file").collect()]
    rows = _rows(spark, path, files, f"{CREATOR} STRING, {schema}").filter(F.col(CREATOR) == profile_url)
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    return placed.orderBy("file", "_at").drop("file", "_at", CREATOR)


def unpack(spark: SparkSession, path: str, schema: str, creators: DataFrame, out: str) -> DataFrame:
    """The chosen creators' rows as CSV files for each of them, with the usual header, in a folder named by a hash of the link.
    Returns (creator, name)."""
    chosen = creators.select(F.col("profile_url").alias(CREATOR)).distinct().withColumn("name", F.sha2(CREATOR, 256))
    files = [r["file"] for r in manifest(spark, path).join(chosen, CREATOR, "left_semi").select("file").distinct().collect()]
    rows = _rows(spark, path, files, f"{CREATOR} STRING, {schema}").withColumn("_at", F.monotonically_increasing_id())
    named = rows.join(chosen, CREATOR).repartitionByRange("name", "file", "_at").sortWithinPartitions("name", "file", "_at")
    named.drop(CREATOR, "file", "_at").write.options(**DIALECT, emptyValue="", nullValue="").partitionBy("name").csv(out)
    return chosen


def pack_comments(comments: DataFrame, path: str) -> None:
    """All creators' comments, newest first."""
    rows = comments.withColumn(CREATOR, F.col("profile_url"))
    pack(rows, path, [F.desc("timestamp"), F.col("comment_id")], schemas.EXPORT_COLUMNS)


def pack_blocklist(blocklist: DataFrame, path: str) -> None:
    """All creators' handles."""
    handles = blocklist.select(F.col("profile_url").alias(CREATOR), F.col("author").alias("Username")).distinct()
    pack(handles, path, [F.col("Username")], ["Username"])
