"""Discussion threads landed as nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.functions import dictionary as fixed
from modlytics.functions.payloads import DEEPEST, TOO_DEEP, payload_status, whole_json
from modlytics.functions.rules import bind
from modlytics.functions.text import epoch_text
from modlytics.session import scratch_path
from modlytics.sources.deep_threads import read_deep_threads
from modlytics.sources.landed import PAGE_BITS, with_landing
from modlytics.sources.tables import write_table

# Where things are in a thread payload.
COMMENT_KIND = "t1"
TITLE_PATH = "$[0].data.children[0].data.title"
TOP_NODES_PATH = "$[1].data.children"
REPLY_NODES_PATH = "$.data.replies.data.children"

#: Brackets that one reply level opens, and so the number of levels that a readable payload can have.
BRACKETS_PER_LEVEL = 5
LEVELS = DEEPEST // BRACKETS_PER_LEVEL

_COMMENTS = "array<struct<path: array<int>, author: string, body: string, created_utc: double>>"
_OPEN = "array<struct<path: array<int>, replies: array<variant>>>"


def _nodes(tree: Column, path: str) -> Column:
    return F.try_variant_get(tree, path, "array<variant>")


def _comments_of(nodes: Column, parent: Column) -> Column:
    """The comment nodes among siblings, each with its path: the parent's path and its own place."""

    def read(node: Column, place: Column) -> Column:
        return F.struct(
            F.concat(parent, F.array(place)).alias("path"),
            F.try_variant_get(node, "$.kind", "string").alias("kind"),
            F.try_variant_get(node, "$.data.author", "string").alias("author"),
            F.try_variant_get(node, "$.data.body", "string").alias("body"),
            F.try_variant_get(node, "$.data.created_utc", "double").alias("created_utc"),
            _nodes(node, REPLY_NODES_PATH).alias("replies"),
        )

    return F.filter(F.transform(nodes, read), lambda comment: comment["kind"] == COMMENT_KIND)


def _unfolded(top: Column) -> Column:
    """All comment nodes below the top ones, level by level inside the row.

    The loop goes on for as many levels as a readable payload can have; past the last reply of a
    thread a turn only looks at an empty list.
    """
    start = F.struct(
        F.array().cast(_COMMENTS).alias("done"),
        F.array(F.struct(F.array().cast("array<int>").alias("path"), top.alias("replies"))).cast(_OPEN).alias("open"),
    )

    def level(state: Column, _: Column) -> Column:
        found = F.flatten(F.transform(state["open"], lambda o: _comments_of(o["replies"], o["path"])))

        def split(comments: Column) -> Column:
            read = F.transform(comments, lambda c: F.struct(*[c[n].alias(n) for n in ("path", "author", "body", "created_utc")]))
            answered = F.filter(comments, lambda c: c["replies"].isNotNull())
            left = F.transform(answered, lambda c: F.struct(c["path"].alias("path"), c["replies"].alias("replies")))
            return F.struct(F.concat(state["done"], read).alias("done"), left.alias("open"))

        return F.when(F.size(state["open"]) == 0, state).otherwise(bind(found, split))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, level)["done"]


def _written(comments: Column) -> Column:
    """Comments with a body that is neither empty nor removed. A parent comes before its replies and these
    before its next sibling, which is the order of the paths as arrays."""
    return F.array_sort(F.filter(comments, lambda c: (c["body"] != "") & ~c["body"].isin(fixed.REMOVED_BODIES)))


def read_threads(payloads: DataFrame, keep_unread: bool = False) -> DataFrame:
    """(profile_url, landed_at, page, status, title, comments), one row per payload.

    With ``keep_unread`` there also is a column ``unread``: the payload, where it is too deep for the JSON reader.

    Each payload is parsed once and stays in its row: nothing is shuffled or kept. A payload that is
    not a list of two or more has no comments. Nodes that are removed still pass their replies on.
    """
    landed = with_landing(payloads)
    keys = ["profile_url", "landed_at", "page"]

    def of(tree: Column) -> Column:
        top = _nodes(tree, TOP_NODES_PATH)
        found = F.when(top.isNotNull(), _written(_unfolded(top)))
        return F.struct(
            top.isNull().alias("failed"),
            F.coalesce(F.try_variant_get(tree, TITLE_PATH, "string"), F.lit(fixed.THREAD_TITLE)).alias("title"),
            found.alias("comments"),
        )

    read = landed.select(*keys, "payload", bind(whole_json(F.col("payload")), of).alias("read"))
    found = read.select(
        *keys,
        payload_status(F.col("payload"), F.col("read.failed"), F.size("read.comments")).alias("status"),
        F.col("read.title").alias("title"),
        F.col("read.comments").alias("comments"),
        *([F.col("payload")] if keep_unread else []),
    )
    if not keep_unread:
        return found
    return found.withColumn("unread", F.when(F.col("status") == TOO_DEEP, F.col("payload"))).drop("payload")


def read_all_threads(payloads: DataFrame) -> DataFrame:
    """read_threads with those that are too deep for the JSON reader read as well, token by token. All are written once, so that no
    payload is parsed for each use."""
    spark = payloads.sparkSession
    read = write_table(read_threads(payloads, keep_unread=True), scratch_path(spark, "threads"))
    shallow, deep = read.filter("unread is null").drop("unread"), read_deep_threads(read.filter("unread is not null"))
    return shallow.unionByName(write_table(deep, scratch_path(spark, "deep-threads")))


def comments_of_threads(threads: DataFrame, ingest_time: str, rows_per_thread: int | None = None) -> DataFrame:
    """read_threads -> (profile_url, pos, author, text, timestamp). All rows, or at most so many of a payload.

    The limit counts rows that are left after dropping empty and removed bodies.
    """
    kept = F.col("comments") if rows_per_thread is None else F.slice("comments", 1, rows_per_thread)
    # The outer form, as the plain one has the optimizer test the size of the array beforehand, which
    # would unfold each payload a second time.
    rows = threads.select("profile_url", "page", F.posexplode_outer(kept).alias("place", "comment"))
    return rows.filter(F.col("place").isNotNull()).select(
        "profile_url",
        (F.shiftleft("page", PAGE_BITS) + F.col("place")).alias("pos"),
        F.concat(F.lit("u/"), F.coalesce("comment.author", F.lit(fixed.ANONYMOUS))).alias("author"),
        F.col("comment.body").alias("text"),
        epoch_text(F.col("comment.created_utc"), F.lit(ingest_time)).alias("timestamp"),
    )


def thread_comments(payloads: DataFrame, ingest_time: str, rows_per_thread: int | None = None) -> DataFrame:
    """(profile_url, payload) with or without landed_at and page -> (profile_url, pos, author, text, timestamp)."""
    return comments_of_threads(read_threads(payloads), ingest_time, rows_per_thread)


def thread_titles(payloads: DataFrame) -> DataFrame:
    """(profile_url, payload) -> (profile_url, title)."""
    title = F.coalesce(F.try_variant_get(whole_json(F.col("payload")), TITLE_PATH, "string"), F.lit(fixed.THREAD_TITLE))
    return payloads.select("profile_url", title.alias("title"))
