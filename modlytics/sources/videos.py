"""Video comment pages landed as flat JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics import schemas
from modlytics.functions import dictionary as fixed
from modlytics.functions.payloads import payload_status, whole_json_as
from modlytics.functions.rules import bind
from modlytics.functions.text import iso_text, strip_tags
from modlytics.sources.landed import PAGE_BITS, with_landing


def video_titles(payloads: DataFrame) -> DataFrame:
    """(profile_url, payload) of video details -> (profile_url, title); null where there is none."""
    info = whole_json_as(F.col("payload"), schemas.VIDEO_INFO)
    return payloads.select("profile_url", F.get(info["items"], 0)["snippet"]["title"].alias("title"))


def _has_comment(item: Column) -> Column:
    return item["snippet"]["topLevelComment"]["snippet"].isNotNull()


def read_pages(payloads: DataFrame) -> DataFrame:
    """(profile_url, landed_at, page, status, items), one row per payload, each parsed once.

    A page with an item that has no comment inside counts as failed as a whole and has no items.
    """
    landed = with_landing(payloads)

    def of(page: Column) -> Column:
        whole = F.forall(page["items"], _has_comment)
        failed = page.isNull() | ~F.coalesce(whole, F.lit(True))
        return F.struct(failed.alias("failed"), F.when(whole, page["items"]).alias("items"))

    keys = ["profile_url", "landed_at", "page"]
    read = landed.select(*keys, "payload", bind(whole_json_as(F.col("payload"), schemas.VIDEO_PAGE), of).alias("read"))
    status = payload_status(F.col("payload"), F.col("read.failed"), F.size("read.items"))
    return read.select(*keys, status.alias("status"), F.col("read.items").alias("items"))


def comments_of_pages(pages: DataFrame, ingest_time: str) -> DataFrame:
    """read_pages -> (profile_url, pos, author, text, timestamp), top-level comments only.

    The position goes on from page to page: a key never repeats, however many pages a link has.
    """
    # The outer form, as a filter on the parsed items, given or inferred, would be moved below the
    # parsing and parse each page again.
    items = pages.select("profile_url", "page", F.posexplode_outer("items").alias("place", "item"))
    return items.filter(F.col("place").isNotNull()).select(
        "profile_url",
        (F.shiftleft("page", PAGE_BITS) + F.col("place")).alias("pos"),
        F.coalesce("item.snippet.topLevelComment.snippet.authorDisplayName", F.lit(fixed.ANONYMOUS)).alias("author"),
        F.coalesce(strip_tags(F.col("item.snippet.topLevelComment.snippet.textDisplay")), F.lit("")).alias("text"),
        iso_text(F.col("item.snippet.topLevelComment.snippet.publishedAt"), F.lit(ingest_time)).alias("timestamp"),
    )


def video_comments(payloads: DataFrame, ingest_time: str) -> DataFrame:
    """(profile_url, payload) with or without landed_at and page -> (profile_url, pos, author, text, timestamp)."""
    return comments_of_pages(read_pages(payloads), ingest_time)
