"""Filtered, searched and ordered comment views.

Filters on creator and class are plain comparisons on stored columns and reach the parquet scan; that
on a creator also names its bucket, so other partition directories are not opened. Order matters inside
a creator: a view of many creators is sorted inside its partitions, without a shuffle of texts; a view
of one creator is sorted as a whole. Orderings end in the comment id, which settles ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlytics import schemas
from modlytics.functions import dictionary as fixed
from modlytics.functions.scores import severity_percent
from modlytics.functions.text import highlight
from modlytics.sources.tables import bucket_of

VIEW_COLUMNS = ["profile_url", "comment_id", *schemas.EXPORT_COLUMNS]


def newest_first(comments: DataFrame) -> DataFrame:
    return comments.select(*VIEW_COLUMNS).sortWithinPartitions("profile_url", F.desc("timestamp"), "comment_id")


def gravest_first(comments: DataFrame) -> DataFrame:
    return comments.select(*VIEW_COLUMNS).sortWithinPartitions("profile_url", F.desc("severity_score"), "comment_id")


def of_creator(comments: DataFrame, profile_url: str) -> DataFrame:
    """One creator's comments, of which a bucketed table reads one bucket, whatever number of them it was written with."""
    own = comments.filter(F.col("profile_url") == profile_url)
    if not {"buckets", "bucket"} <= set(comments.columns):
        return own
    return own.filter(F.col("bucket") == bucket_of(F.lit(profile_url), F.col("buckets")))


def newest_of_creator(comments: DataFrame, profile_url: str) -> DataFrame:
    return of_creator(comments, profile_url).select(*VIEW_COLUMNS).orderBy(F.desc("timestamp"), "comment_id")


def of_creators(comments: DataFrame, creators: DataFrame) -> DataFrame:
    return comments.join(creators.select("profile_url").distinct(), "profile_url", "left_semi")


def by_class(comments: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Comments of the classes, gravest first; without classes all comments, newest first."""
    if not classes:
        return newest_first(comments)
    return gravest_first(comments.filter(F.col("classification").isin(*classes)))


def in_categories(comments: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """Comments of the switched-on categories, at first all but proper; none switched on shows none."""
    chosen = fixed.ISSUE_CLASSES if selected is None else selected
    return comments.filter(F.col("classification").isin(*chosen))


def search(comments: DataFrame, term: str = "") -> DataFrame:
    """Comments whose text has a match of the pattern, whatever its case; no term shows all."""
    return comments.filter(F.regexp_like("text", F.lit(f"(?iu){term}"))) if term else comments


def flagged_view(comments: DataFrame, selected: list[str] | None = None, term: str = "") -> DataFrame:
    return newest_first(search(in_categories(comments, selected), term))


def filtered_counts(
    creators: DataFrame, comments: DataFrame, selected: list[str] | None = None, term: str = ""
) -> DataFrame:
    """Shown comments of every creator; 0 where none match."""
    shown = search(in_categories(comments, selected), term)
    counted = shown.groupBy("profile_url").agg(F.count(F.lit(1)).alias("n"))
    return creators.select("profile_url").join(counted, "profile_url", "left").select(
        "profile_url", F.coalesce("n", F.lit(0)).alias("shown_comments")
    )


def comment_cards(comments: DataFrame, escape: bool = False) -> DataFrame:
    """Comments as they are shown: whole severity percent and triggers marked in the text."""
    return comments.withColumns(
        {
            "severity_percent": severity_percent(F.col("severity_score")),
            "marked_text": highlight(F.col("text"), F.col("flagged_words"), escape=escape),
        }
    )
