"""Comment, creator, label and payload tables derived from the given tables.

Creator links, authors and times follow from the ids, so that the same views can be written in SQL.
All rows and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics.functions import dictionary as fixed
from modlytics.operators import generations
from modlytics.operators.analytics import safety_scores
from modlytics.operators.labels import cut_batches
from modlytics.operators.moderation import moderate
from modlytics.operators.positions import dense_positions
from modlytics.operators.tables import write_scores
from modlytics.plans.scan import creator_names
from modlytics.session import scratch_path
from modlytics.sources.tables import read_comments, read_table, write_table

INGEST_TIME = "2024-02-01 00:00:00"
BATCH_ROWS = 20
TURNS_PER_THREAD = 256
COMMENTS_PER_PAGE = 100
SOURCE_NUMBER = "cast(substring(source, 4) as int)"

# Expressions that both engines read alike.
PROFILE_URL = f"""
    case {SOURCE_NUMBER} % 6
        when 0 then 'https://www.reddit.com/r/gaming/comments/' || source || '/t/'
        when 1 then 'https://youtu.be/' || source
        when 2 then 'https://instagram.com/' || source
        when 3 then 'https://x.com/' || source
        when 4 then 'https://www.tiktok.com/@' || source
        else 'https://example.org/c/' || source
    end"""
AUTHOR = "'user_' || cast(doc_id % 7 as string)"
TIMESTAMP = "cast(timestamp '2024-01-01 00:00:00' + doc_id * interval '1' minute as string)"


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read_table(spark, folder, "documents", *columns)


def raw_comments(spark: SparkSession, folder: str) -> DataFrame:
    """documents as raw comments: whole texts, some twenty creators, seven authors each."""
    return documents(spark, folder, "doc_id", "source", "text").selectExpr(
        f"{PROFILE_URL} as profile_url", "doc_id as comment_id", f"{AUTHOR} as author", "text", f"{TIMESTAMP} as timestamp"
    )


def links(spark: SparkSession, folder: str) -> DataFrame:
    """The creator links of raw_comments with the hour of their last scan, and one without comments."""
    found = (
        documents(spark, folder, "source")
        .distinct()
        .selectExpr(
            f"{PROFILE_URL} as profile_url",
            f"timestamp '{INGEST_TIME}' + {SOURCE_NUMBER} * interval '1' hour as last_scanned",
        )
    )
    quiet = spark.range(1).selectExpr(
        "'https://example.org/c/quiet' as profile_url", f"timestamp '{INGEST_TIME}' as last_scanned"
    )
    return found.unionByName(quiet)


def creators(spark: SparkSession, folder: str) -> DataFrame:
    urls = links(spark, folder)
    named = creator_names(urls, urls.select("profile_url", F.lit(None).cast("string").alias("title")))
    return named.select(
        "profile_url", "platform", "creator_name", F.lit(fixed.EMPTY_SCORE).alias("safety_score"), "last_scanned"
    )


def store_tables(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Writes creators and comments as a scan leaves them: a store with one generation, and the creators as a table.
    Returns the paths of the table and of the store."""
    store, creators_path = scratch_path(spark, "store"), scratch_path(spark, "creators")
    # Labelled where the texts are read, numbered after: the shuffle that numbers a creator's
    # comments then does not decide how evenly the rules run.
    labelled = moderate(raw_comments(spark, folder))
    numbered = dense_positions(labelled, "profile_url", "comment_id", keys_of=raw_comments(spark, folder))
    known = creators(spark, folder)
    staged = generations.stage(spark, store, numbered, INGEST_TIME, links(spark, folder).count())
    scored = write_table(write_scores(known, safety_scores(staged.comments)), creators_path)
    generations.commit(spark, store, staged, scored)
    return creators_path, store


_stored: dict[tuple[str, str, str], tuple[str, str]] = {}


def _version(spark: SparkSession, folder: str) -> str:
    """Sizes and times of the source's files: tables that were stored before a change are not used after it."""
    source = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/documents.parquet")
    files = source.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(source)
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


def _paths(spark: SparkSession, folder: str) -> tuple[str, str]:
    key = (spark.sparkContext.applicationId, folder, _version(spark, folder))
    if key not in _stored:
        _stored[key] = store_tables(spark, folder)
    return _stored[key]


def stored_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The tables of store_tables, stored at the first use in a session for each state of the source.

    Reports at scale read a few narrow columns of these tables; labelling all texts anew for each
    report would cost far more than the report.
    """
    creators_path, path = _paths(spark, folder)
    return spark.read.parquet(creators_path), read_comments(spark, f"{path}/comments/generation=0")


def store(spark: SparkSession, folder: str) -> str:
    """The path of the store. Its first generation is that of stored_tables; a query that adds to it reads what it added
    on top of that alone."""
    return _paths(spark, folder)[1]


def _label(toxic: Column, quality: Column) -> list[Column]:
    """A label from the labels table: toxic, of an unknown class, or proper."""
    return [
        F.when(toxic == 1, "Toxic").when(quality == 0, "LowQuality").otherwise("Proper").alias("classification"),
        F.when(toxic == 1, 0.9).when(quality == 0, 0.3).otherwise(0.0).alias("severity_score"),
        F.lit("").alias("flagged_words"),
    ]


def label_items(spark: SparkSession, folder: str) -> DataFrame:
    """Outside labels by batch and id. Some comments have none."""
    _, comments = stored_tables(spark, folder)
    given = read_table(spark, folder, "labels", "doc_id", "quality", "toxic")
    keys = cut_batches(comments.select("profile_url", "pos", "comment_id"), BATCH_ROWS)
    return keys.join(given, F.col("comment_id") == F.col("doc_id")).select(
        "profile_url", "batch_id", "id", F.col("id").alias("item"), *_label(F.col("toxic"), F.col("quality"))
    )


def landed_labels(spark: SparkSession, folder: str) -> DataFrame:
    """One answer per batch of stored comments: a JSON array, broken in one of three ways in the first
    batch of the creators of three platforms."""
    _, comments = stored_tables(spark, folder)
    keys = cut_batches(comments.select("profile_url", "pos"), BATCH_ROWS).select("profile_url", "batch_id", "id")
    items = keys.join(label_items(spark, folder), ["profile_url", "batch_id", "id"], "left")
    entry = F.struct("id", "classification", "severity_score", "flagged_words")
    good = items.groupBy("profile_url", "batch_id").agg(
        F.to_json(F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), entry)))).alias("good")
    )
    url, first = F.col("profile_url"), F.col("batch_id") == 0

    def with_item(item: str) -> Column:
        return F.concat(F.lit(f"[{item}"), F.when(F.col("good") == "[]", "").otherwise(","), F.substring("good", 2, 2**30))

    payload = (
        F.when(first & url.contains("youtu.be"), F.concat("good", F.lit("[{")))
        .when(first & url.contains("instagram"), with_item('{"classification":"Spam"}'))
        .when(first & url.contains("tiktok"), with_item('{"id":0,"severity_score":"high"}'))
        .otherwise(F.col("good"))
    )
    return good.select("profile_url", "batch_id", payload.alias("payload"))


SCAN = "first"
SENT_AT = "2024-02-01 00:00:00"
LABEL_EVENT = "profile_url STRING, scan STRING, batches BIGINT, batch_id BIGINT, payload STRING, at TIMESTAMP"


def label_events(spark: SparkSession, folder: str) -> DataFrame:
    """Batches sent to a labeller, one announcement per creator, and its answers as landed_labels has them. They come within
    50 minutes, but the first one on each creator of one platform comes two hours later."""
    _, comments = stored_tables(spark, folder)
    sent = F.lit(SENT_AT).cast("timestamp")
    announced = comments.groupBy("profile_url").agg((F.max(F.expr(f"pos div {BATCH_ROWS}")) + 1).alias("batches")).select(
        "profile_url", F.lit(SCAN).alias("scan"), "batches", F.lit(None).cast("bigint").alias("batch_id"), F.lit(None).cast("string").alias("payload"), sent.alias("at")
    )
    delay = F.when((F.col("batch_id") == 0) & F.contains("profile_url", F.lit("x.com")), 7200).otherwise(F.col("batch_id") % 3000)
    answers = landed_labels(spark, folder).select(
        "profile_url", F.lit(SCAN).alias("scan"), F.lit(None).cast("bigint").alias("batches"), "batch_id", "payload",
        F.timestamp_seconds(F.unix_timestamp(sent) + delay).alias("at"),
    )
    return announced.unionByName(answers)


def _json_node(turn: Column, replies: Column, close: bool = True) -> Column:
    """One thread node as JSON. Some have no author or time, some bodies are empty or removed. Without ``close`` what ends the node
    is left out."""
    mark = turn["conv_id"] + turn["turn"]
    body = (
        F.when(mark % 11 == 0, "[deleted]").when(mark % 17 == 0, "[removed]").when(mark % 19 == 0, "").otherwise(turn["text"])
    )
    fields = F.to_json(
        F.struct(
            F.when(mark % 13 != 0, turn["role"]).alias("author"),
            body.alias("body"),
            F.when(mark % 7 != 0, turn["conv_id"] * 3600 + turn["turn"] * 60 + 1704067200.0).alias("created_utc"),
        )
    )
    return F.concat(
        F.lit('{"kind":"t1","data":'), F.regexp_replace(fields, r"\}$", ""), F.lit(',"replies":'), replies, F.lit("}}" if close else "")
    )


def landed_threads(spark: SparkSession, folder: str) -> DataFrame:
    """conversations as nested thread payloads, at most TURNS_PER_THREAD turns in each.

    Folding the turns from last to first, a turn either takes all later ones as its replies or
    stands before them as a sibling; either way reading in pre-order gives back the turns in order.
    """
    turns = read_table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    grouped = turns.groupBy("conv_id", F.expr(f"turn div {TURNS_PER_THREAD}").alias("part")).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("turn", "conv_id", "role", "text")))).alias("turns")
    )

    def fold(later: Column, turn: Column) -> Column:
        nests = turn["turn"] % 3 != 2
        replies = F.when(nests & (later != ""), F.concat(F.lit('{"data":{"children":['), later, F.lit("]}}")))
        more = F.when(turn["turn"] % 4 == 1, ',{"kind":"more","data":{"count":1}}').otherwise("")
        after = F.when(nests | (later == ""), "").otherwise(F.concat(F.lit(","), later))
        return F.concat(_json_node(turn, F.coalesce(replies, F.lit('""'))), more, after)

    nodes = F.aggregate("turns", F.lit(""), fold)
    return grouped.select(
        F.concat(
            F.lit("https://www.reddit.com/r/talk/comments/c"), F.col("conv_id"), F.lit("p"), F.col("part"), F.lit("/t/")
        ).alias("profile_url"),
        F.concat(
            F.lit('[{"data":{"children":[{"data":{"title":"Talk '), F.col("conv_id"),
            F.lit('"}}]}},{"data":{"children":['), nodes, F.lit("]}}]"),
        ).alias("payload"),
    )


CONVERSATIONS_PER_CHAIN = 200


def landed_chains(spark: SparkSession, folder: str) -> DataFrame:
    """conversations as thread payloads in which every turn is the only reply to the one before, CONVERSATIONS_PER_CHAIN of them in
    each."""
    turns = read_table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    part = F.expr(f"conv_id div {CONVERSATIONS_PER_CHAIN}").alias("part")
    grouped = turns.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "role", "text"))).alias("turns"))
    open_node = lambda turn: _json_node(turn, F.lit('{"data":{"children":['), close=False)
    nodes = F.concat(F.array_join(F.transform("turns", open_node), ""), F.repeat(F.lit("]}}}}"), F.size("turns")))
    return grouped.select(
        F.concat(F.lit("https://www.reddit.com/r/talk/comments/chain"), F.col("part"), F.lit("/t/")).alias("profile_url"),
        F.concat(F.lit('[{"data":{"children":[{"data":{"title":"Chain"}}]}},{"data":{"children":['), nodes, F.lit("]}}]")).alias("payload"),
    )


def landed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """documents as video comment pages, at most COMMENTS_PER_PAGE comments on each.

    Texts are wrapped in tags; some comments have no author or no time.
    """
    scan = documents(spark, folder, "doc_id", "source", "text")
    item = F.struct(
        F.struct(
            F.struct(
                F.struct(
                    F.when(F.col("doc_id") % 7 != 3, F.expr(AUTHOR)).alias("authorDisplayName"),
                    F.concat(F.lit("<b class='t'>"), "text", F.lit("</b><br>")).alias("textDisplay"),
                    F.when(
                        F.col("doc_id") % 9 != 0, F.expr(f"replace({TIMESTAMP}, ' ', 'T') || 'Z'")
                    ).alias("publishedAt"),
                ).alias("snippet")
            ).alias("topLevelComment")
        ).alias("snippet")
    )
    page = F.expr(f"doc_id div {COMMENTS_PER_PAGE}")
    return (
        scan.groupBy("source", page.alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("rows"))
        .select(
            F.concat(F.lit("https://youtu.be/"), "source", F.lit("_"), "page").alias("profile_url"),
            F.to_json(F.struct(F.transform("rows", lambda r: r["item"]).alias("items"))).alias("payload"),
        )
    )


LATER_SCAN, EARLIER_SCAN = "2024-01-31 00:00:00", "2024-01-30 00:00:00"


def landed_scans(spark: SparkSession, folder: str) -> DataFrame:
    """documents as video pages of one link per source, landed by two scans. The earlier one has every
    other page, from which the comments were since deleted. Some payloads of sources are broken or empty."""
    pages = landed_pages(spark, folder).withColumn("page", F.regexp_extract("profile_url", "_([0-9]+)$", 1).cast("bigint"))
    link = F.regexp_replace("profile_url", "_[0-9]+$", "")
    number = F.regexp_extract("profile_url", "src([0-9]+)_", 1).cast("int")
    payload = F.when((number % 7 == 5) & (F.col("page") % 2 == 0), F.regexp_replace("payload", r"\}$", ""))
    payload = payload.when((number % 7 == 6) & (F.col("page") % 2 == 1), F.lit('{"items":[]}')).otherwise(F.col("payload"))
    later = pages.select(link.alias("profile_url"), F.lit(LATER_SCAN).cast("timestamp").alias("landed_at"), "page", payload.alias("payload"))
    earlier = later.filter("page % 2 = 0").withColumns(
        {"landed_at": F.lit(EARLIER_SCAN).cast("timestamp"), "payload": F.lit('{"items":[]}')}
    )
    return later.unionByName(earlier)
