"""Scan: landed payloads of links -> labelled comments, scored creators, next table versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics.functions import dictionary as fixed
from modlytics.functions.links import display_name, handle_of, platform_of
from modlytics.operators import generations
from modlytics.operators.analytics import safety_scores
from modlytics.operators.labels import cut_batches, hybrid_labels, label_payloads
from modlytics.operators.moderation import moderate, normalise
from modlytics.operators.tables import replace_comments, upsert_creators
from modlytics.sources.landed import latest_scans
from modlytics.sources.tables import write_comments
from modlytics.sources.threads import comments_of_threads, read_all_threads, thread_comments
from modlytics.sources.videos import comments_of_pages, read_pages, video_comments, video_titles


def with_link_parts(links: DataFrame) -> DataFrame:
    """(profile_url, ...) with platform and handle."""
    url = F.col("profile_url")
    return links.withColumn("platform", platform_of(url)).withColumn("handle", handle_of(url, F.col("platform")))


def creator_names(links: DataFrame, titles: DataFrame) -> DataFrame:
    """Platform, handle and display name of each link; a landed title goes before the handle."""
    return (
        with_link_parts(links)
        .join(titles, "profile_url", "left")
        .withColumn("creator_name", display_name(F.col("platform"), F.col("handle"), F.col("title")))
    )


def _keyed(comments: DataFrame) -> DataFrame:
    return normalise(comments.withColumn("comment_id", F.xxhash64("profile_url", "pos")))


def raw_comments(
    threads: DataFrame, pages: DataFrame, ingest_time: str, rows_per_thread: int | None = None
) -> DataFrame:
    """Comments of the latest landed threads and video pages of each link, all of them if no limit is given.

    The key is (profile_url, pos), of which comment_id is a hash.
    """
    found = thread_comments(latest_scans(threads), ingest_time, rows_per_thread)
    return _keyed(found.unionByName(video_comments(latest_scans(pages), ingest_time)))


def landed_status(threads: DataFrame, pages: DataFrame) -> DataFrame:
    """(profile_url, landed_at, page, status) of every landed payload, whichever scan it is of."""
    keys = ["profile_url", "landed_at", "page", "status"]
    return read_all_threads(threads).select(*keys).unionByName(read_pages(pages).select(*keys))


def label_requests(comments: DataFrame, rows_per_batch: int = fixed.LABEL_BATCH_ROWS) -> DataFrame:
    """What an outside labeller is to be sent, batch by batch."""
    return label_payloads(cut_batches(comments, rows_per_batch))


def label(
    comments: DataFrame, parsed: DataFrame | None = None, rows_per_batch: int = fixed.LABEL_BATCH_ROWS
) -> DataFrame:
    """Comments labelled by the rules, or by the parsed answers of a labeller with the rules as fallback."""
    if parsed is None:
        return moderate(comments)
    return hybrid_labels(cut_batches(comments, rows_per_batch), parsed).drop("batch_id", "id", "scan_ok")


def scanned_creators(links: DataFrame, titles: DataFrame, comments: DataFrame, ingest_time: str) -> DataFrame:
    """The creators whose scan brought comments, with name and score. An empty scan is not stored."""
    scored = creator_names(links, titles).join(safety_scores(comments), "profile_url")
    return scored.select(
        "profile_url",
        "platform",
        "creator_name",
        "safety_score",
        F.to_timestamp(F.lit(ingest_time)).alias("last_scanned"),
    )


def labelled_scan(
    threads: DataFrame,
    pages: DataFrame,
    ingest_time: str,
    video_details: DataFrame | None = None,
    parsed_labels: DataFrame | None = None,
    rows_per_thread: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Labelled comments of one scan of landed threads and pages, and the landed titles of its links.

    Each thread is parsed once, for its title, comments and status. Nothing is labelled until the comments are written.
    """
    read = read_all_threads(latest_scans(threads))
    found = comments_of_threads(read, ingest_time, rows_per_thread)
    found = found.unionByName(comments_of_pages(read_pages(latest_scans(pages)), ingest_time))
    titles = read.groupBy("profile_url").agg(F.min_by("title", "page").alias("title"))
    if video_details is not None:
        named = video_titles(latest_scans(video_details)).groupBy("profile_url").agg(F.max("title").alias("title"))
        titles = titles.unionByName(named)
    return label(_keyed(found), parsed_labels), titles


def scan(
    threads: DataFrame,
    pages: DataFrame,
    ingest_time: str,
    comments_path: str,
    video_details: DataFrame | None = None,
    parsed_labels: DataFrame | None = None,
    rows_per_thread: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Creators and comments of one scan of landed threads and pages.

    The labelled comments are written by bucket to ``comments_path``, a new path in shared storage. Scores and whatever
    the caller does with the comments read them from there, so texts are labelled once.
    """
    labelled, titles = labelled_scan(threads, pages, ingest_time, video_details, parsed_labels, rows_per_thread)
    comments = write_comments(labelled, comments_path).drop("buckets", "bucket")
    links = comments.select("profile_url").distinct()
    return scanned_creators(links, titles, comments, ingest_time), comments


def scan_into(
    spark: SparkSession,
    store: str,
    threads: DataFrame,
    pages: DataFrame,
    ingest_time: str,
    video_details: DataFrame | None = None,
    parsed_labels: DataFrame | None = None,
    rows_per_thread: int | None = None,
    batch: tuple[str, int] | None = None,
) -> int:
    """One scan into a store kept by generation: creators and comments in one step, and only the scanned links' rows are
    written, once. Links whose scan brought no comments stay as they are. Returns the generation."""
    labelled, titles = labelled_scan(threads, pages, ingest_time, video_details, parsed_labels, rows_per_thread)
    links = threads.select("profile_url").unionByName(pages.select("profile_url")).distinct().count()
    staged = generations.stage(spark, store, labelled, ingest_time, links)
    found = staged.comments.select("profile_url").distinct()
    return generations.commit(spark, store, staged, scanned_creators(found, titles, staged.comments, ingest_time), batch)


def next_tables(
    creators: DataFrame, comments: DataFrame, new_creators: DataFrame, new_comments: DataFrame, ingest_time: str
) -> tuple[DataFrame, DataFrame]:
    """Both tables after a scan, whole. Write each to a new path, then point readers to it. scan_into writes less."""
    replaced = replace_comments(comments, new_comments, ingest_time, scanned_creators=new_creators)
    return upsert_creators(creators, new_creators), replaced
