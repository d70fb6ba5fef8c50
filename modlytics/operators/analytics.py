"""Per-creator numbers over labelled comments, for all creators in one job.

Each aggregate counts on the map side first, so a creator or author with a large share of all
comments sends one partial row per task and not its comments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlytics.functions import dictionary as fixed
from modlytics.functions.links import creator_label
from modlytics.functions.scores import chart_order, safety_band, safety_score, safety_text, scan_band

CLASS_COLUMNS = {c: f"{c.lower()}_comments" for c in fixed.CLASSES}


def _is(*classes: str) -> Column:
    return F.col("classification").isin(*classes)


def _not_proper() -> Column:
    return F.col("classification") != fixed.PROPER


def safety_scores(comments: DataFrame) -> DataFrame:
    counted = comments.groupBy("profile_url").agg(
        F.count_if(_is(fixed.PROPER)).alias("proper_comments"), F.count(F.lit(1)).alias("total_comments")
    )
    return counted.withColumn("safety_score", safety_score(F.col("proper_comments"), F.col("total_comments")))


def safety_bands(scores: DataFrame) -> DataFrame:
    score = F.col("safety_score")
    return scores.withColumns(
        {"scan_band": scan_band(score), "safety_band": safety_band(score), "safety_text": safety_text(score)}
    )


def class_counts(creators: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments per creator and class: the five classes always, unknown ones where they occur."""
    return _zero_filled(creators, comments.groupBy("profile_url", "classification").agg(F.count(F.lit(1)).alias("n")))


def _zero_filled(creators: DataFrame, counted: DataFrame) -> DataFrame:
    known = creators.select("profile_url", F.explode(F.array(*[F.lit(c) for c in fixed.CLASSES])).alias("classification"))
    return known.join(counted, ["profile_url", "classification"], "full_outer").select(
        "profile_url", "classification", F.coalesce("n", F.lit(0)).alias("comments")
    )


def class_distribution(counts: DataFrame) -> DataFrame:
    """Class counts with their place in the chart, in that order."""
    return counts.withColumn("chart_order", chart_order(F.col("classification"))).orderBy(
        "profile_url", "chart_order", "classification"
    )


def creator_rollup(creators: DataFrame, comments: DataFrame) -> DataFrame:
    """All creators, latest scan first, with all and flagged comments; flagged is whatever is not proper."""
    counted = comments.groupBy("profile_url").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_not_proper()).alias("flagged")
    )
    return _rolled_up(creators, counted)


def _rolled_up(creators: DataFrame, counted: DataFrame) -> DataFrame:
    name, platform = F.col("creator_name"), F.col("platform")
    return (
        creators.join(counted, "profile_url", "left")
        .select(
            "profile_url",
            "platform",
            "creator_name",
            "safety_score",
            "last_scanned",
            F.coalesce("total", F.lit(0)).alias("total_comments"),
            F.coalesce("flagged", F.lit(0)).alias("flagged_comments"),
            creator_label(name, platform, F.col("safety_score")).alias("dashboard_label"),
            creator_label(name, platform).alias("manager_label"),
        )
        .orderBy(F.desc("last_scanned"), "profile_url")
    )


def _ranked(violations: DataFrame, n: int) -> DataFrame:
    """The n authors with most violations per creator. Each task keeps its own n before the shuffle."""
    most = Window.partitionBy("profile_url").orderBy(F.desc("violations_count"), "author")
    return violations.withColumn("place", F.row_number().over(most)).filter(F.col("place") <= n)


def top_offenders(comments: DataFrame, n: int = fixed.TOP_OFFENDERS) -> DataFrame:
    violations = (
        comments.filter(_not_proper()).groupBy("profile_url", "author").agg(F.count(F.lit(1)).alias("violations_count"))
    )
    return _ranked(violations, n)


def blocklist(comments: DataFrame) -> DataFrame:
    """Authors per creator with an abusive, harmful or spam comment. Merely toxic authors are not blocked."""
    return comments.filter(_is(*fixed.BLOCKED_CLASSES)).select("profile_url", "author").distinct()


def author_tallies(comments: DataFrame) -> DataFrame:
    """Comments per creator, author and class: small, and enough for every number of the dashboard."""
    return comments.groupBy("profile_url", "author", "classification").agg(F.count(F.lit(1)).alias("n"))


def scores_of_tallies(tallies: DataFrame) -> DataFrame:
    """safety_scores from author tallies."""
    proper = F.sum(F.when(_is(fixed.PROPER), F.col("n")).otherwise(0)).alias("proper_comments")
    counted = tallies.groupBy("profile_url").agg(proper, F.sum("n").alias("total_comments"))
    return counted.withColumn("safety_score", safety_score(F.col("proper_comments"), F.col("total_comments")))


def class_counts_of_tallies(creators: DataFrame, tallies: DataFrame) -> DataFrame:
    """class_counts from author tallies."""
    return _zero_filled(creators, tallies.groupBy("profile_url", "classification").agg(F.sum("n").alias("n")))


def rollup_of_tallies(creators: DataFrame, tallies: DataFrame) -> DataFrame:
    """creator_rollup from author tallies."""
    flagged = F.sum(F.when(_not_proper(), F.col("n")).otherwise(0)).alias("flagged")
    return _rolled_up(creators, tallies.groupBy("profile_url").agg(F.sum("n").alias("total"), flagged))


def offenders_of_tallies(tallies: DataFrame, n: int = fixed.TOP_OFFENDERS) -> DataFrame:
    """top_offenders from author tallies."""
    violations = tallies.filter(_not_proper()).groupBy("profile_url", "author").agg(F.sum("n").alias("violations_count"))
    return _ranked(violations, n)


def creator_analytics(creators: DataFrame, comments: DataFrame) -> DataFrame:
    """One row per known creator: details, totals, class counts, flagged issues and top offenders."""
    return analytics_of_tallies(creators, author_tallies(comments))


def analytics_of_tallies(creators: DataFrame, tallies: DataFrame) -> DataFrame:
    """creator_analytics from author tallies.

    ``class_counts`` maps every class that occurs to its comments, so its values always sum to the
    total; the five known classes also have columns.

    Totals and offenders both start from the author tallies. Neither filters them before the shuffle,
    so Spark runs it once and reuses it; the comments are read a single time.
    """

    def of(*classes: str) -> Column:
        return F.sum(F.when(_is(*classes), F.col("n")).otherwise(0))

    totals = tallies.groupBy("profile_url").agg(
        F.sum("n").alias("total_comments"),
        *[of(c).alias(name) for c, name in CLASS_COLUMNS.items()],
        of(*fixed.ISSUE_CLASSES).alias("flagged_issues"),
    )
    # One entry per class of a creator.
    classes = (
        tallies.groupBy("profile_url", "classification")
        .agg(F.sum("n").alias("n"))
        .groupBy("profile_url")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("classification", "n")))).alias("class_counts"))
    )
    violations = (
        tallies.groupBy("profile_url", "author")
        .agg(F.sum(F.when(_not_proper(), F.col("n")).otherwise(0)).alias("violations_count"))
        .filter(F.col("violations_count") > 0)
    )
    entry = F.struct("place", "author", "violations_count")
    offenders = _ranked(violations, fixed.TOP_OFFENDERS).groupBy("profile_url").agg(
        F.array_sort(F.collect_list(entry)).alias("top_offenders")
    )
    counts = ["total_comments", *CLASS_COLUMNS.values(), "flagged_issues"]
    return (
        creators.join(totals, "profile_url", "left")
        .join(classes, "profile_url", "left")
        .join(offenders, "profile_url", "left")
        .select(
            "profile_url",
            "creator_name",
            "platform",
            "safety_score",
            "last_scanned",
            F.date_format("last_scanned", fixed.DISPLAY_TIMESTAMP_FORMAT).alias("last_scanned_text"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
            F.coalesce("class_counts", F.create_map().cast("map<string, bigint>")).alias("class_counts"),
            F.coalesce(
                F.transform(
                    "top_offenders",
                    lambda o: F.struct(o["author"].alias("author"), o["violations_count"].alias("violations_count")),
                ),
                F.array().cast("array<struct<author: string, violations_count: bigint>>"),
            ).alias("top_offenders"),
        )
        .transform(safety_bands)
    )
