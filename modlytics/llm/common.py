"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics.session import scratch_path
from modlytics.sources.tables import read_table

#: White space that separates words, as a character class; other Unicode spaces are part of words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read_table(spark, folder, "documents", *columns)


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def stored(table: DataFrame, name: str) -> DataFrame:
    """The table written once to the folder that all executors share, and read back.

    What follows reads the written rows, so an input is not worked through again for each use, and a
    lost executor costs a read.
    """
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """Whole rows as one column, so that no name of an extra column can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")
