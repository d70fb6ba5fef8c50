"""Every query by name: (spark, folder) -> DataFrame over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics import schemas
from modlytics.functions import automaton
from modlytics.functions import dictionary as fixed
from modlytics.functions.links import platform_of
from modlytics.functions.rules import emoji_count, has_emoji_flood, has_link, is_yelling, term_hits, trigger_text
from modlytics.functions.text import strip_tags
from modlytics.operators import analytics, generations, labels, ordered, tables, text_index, views
from modlytics.operators.moderation import moderate, normalise
from modlytics.plans import fixtures
from modlytics.plans.scan import creator_names, landed_status, scan, with_link_parts
from modlytics.session import scratch_path
from modlytics.sources import csv_files
from modlytics.sources.landed import latest_scans
from modlytics.sources.tables import read_table, stream_table, write_table
from modlytics.sources.threads import comments_of_threads, read_all_threads, thread_comments
from modlytics.sources.videos import video_comments
from modlytics.streaming.answers import drain_verdicts
from modlytics.streaming.live import drain, moderate_stream
from modlytics.streaming.tables import keep_tables

Query = Callable[[SparkSession, str], DataFrame]

SEARCH_TERM = r"eau|tion\."
SCORES = ["profile_url", "proper_comments", "total_comments", "safety_score"]
LABELS = ["classification", "severity_score", "flagged_words"]
RESCANNED = ["Reddit", "YouTube"]
DELETED_PLATFORM = "TikTok"
PAGE_ROWS = 5


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.documents(spark, folder, "doc_id", "text")


def _comments(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.stored_tables(spark, folder)[1]


def _creators(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.stored_tables(spark, folder)[0]


# --- rules ---


def _hits(terms: list[str]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        hits = trigger_text(term_hits(F.lower("text"), terms))
        return _texts(spark, folder).select("doc_id", hits.alias("hits"))

    return query


def _text_test(name: str, test: Callable[[Column], Column]) -> Query:
    return lambda spark, folder: _texts(spark, folder).select("doc_id", test(F.col("text")).alias(name))


def detect_emoji(spark: SparkSession, folder: str) -> DataFrame:
    """The given texts hold no counted emoji, so each gets up to 13 of them at its end."""
    text = F.concat("text", F.repeat(F.lit("\U0001F600✈"), (F.col("doc_id") % 7).cast("int")), F.lit("☺"))
    return _texts(spark, folder).select(
        "doc_id", emoji_count(text).alias("emojis"), has_emoji_flood(text).alias("emoji_flood")
    )


def classify_emoji(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with up to 12 emoji put to their end, through the whole cascade: those that no tier before it
    takes reach the emoji tier."""
    text = F.concat("text", F.repeat(F.lit("\U0001F600✈"), (F.col("doc_id") % 7).cast("int"))).alias("text")
    return moderate(_texts(spark, folder).select("doc_id", text)).select("doc_id", *LABELS)


def classify_comments(spark: SparkSession, folder: str) -> DataFrame:
    return moderate(_texts(spark, folder)).select("doc_id", *LABELS)


def classify_by_version(spark: SparkSession, folder: str) -> DataFrame:
    """classify_comments with the rules' lists taken from a table of versions."""
    version = automaton.load_version(automaton.rule_terms(spark), automaton.RULES)
    return moderate(_texts(spark, folder), version=version).select("doc_id", *LABELS)


def term_places(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry of the lists that a text holds, and where it first stands."""
    version = automaton.load_version(automaton.rule_terms(spark), automaton.RULES)
    hits = _texts(spark, folder).select("doc_id", F.explode(automaton.term_places(version)(F.lower("text"))).alias("hit"))
    return hits.select("doc_id", "hit.tier", "hit.place", "hit.term", F.get("hit.starts", F.lit(0)).alias("first"))


def highlight_by_places(spark: SparkSession, folder: str) -> DataFrame:
    """highlight_triggers from the places that one walk over a text finds."""
    version = automaton.load_version(automaton.rule_terms(spark), automaton.RULES)
    marked = automaton.highlight_places(version)(F.col("text"), F.col("flagged_words"))
    return _comments(spark, folder).select("comment_id", marked.alias("marked_text"))


def classify_turns(spark: SparkSession, folder: str) -> DataFrame:
    turns = read_table(spark, folder, "conversations", "conv_id", "turn", "text")
    return moderate(turns).select("conv_id", "turn", *LABELS)


def moderate_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: raw comments -> labels -> score and bands of each creator."""
    comments = moderate(normalise(fixtures.raw_comments(spark, folder)))
    return analytics.safety_bands(analytics.safety_scores(comments))


def stream_moderation(spark: SparkSession, folder: str) -> DataFrame:
    landed = stream_table(spark, folder, "documents", "doc_id BIGINT, text STRING")
    path, progress = scratch_path(spark, "live"), scratch_path(spark, "live-progress")
    author, timestamp = F.lit(None).cast("string"), F.lit(None).cast("string")
    comments = landed.withColumns({"author": author, "timestamp": timestamp})
    drain(moderate_stream(comments, spark.sparkContext.defaultParallelism), path, progress)
    return spark.read.parquet(path).select("doc_id", "author", *LABELS)


# --- sources ---


def reddit_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return thread_comments(fixtures.landed_threads(spark, folder), fixtures.INGEST_TIME)


def reddit_flatten_limited(spark: SparkSession, folder: str) -> DataFrame:
    """At most three rows of each thread."""
    return thread_comments(fixtures.landed_threads(spark, folder), fixtures.INGEST_TIME, rows_per_thread=3)


def reddit_flatten_deep(spark: SparkSession, folder: str) -> DataFrame:
    """Threads in which each turn answers the one before, over many conversations: deeper than the JSON reader goes."""
    read = read_all_threads(fixtures.landed_chains(spark, folder))
    return comments_of_threads(read, fixtures.INGEST_TIME)


def landed_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """What became of each landed payload of two scans."""
    statuses = landed_status(fixtures.landed_threads(spark, folder), fixtures.landed_scans(spark, folder))
    return statuses.withColumn("landed_at", F.date_format("landed_at", fixed.TIMESTAMP_FORMAT))


def youtube_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Comments of the latest of two scans of links with many pages."""
    return video_comments(latest_scans(fixtures.landed_scans(spark, folder)), fixtures.INGEST_TIME)


def youtube_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return video_comments(fixtures.landed_pages(spark, folder), fixtures.INGEST_TIME)


def scan_links(spark: SparkSession, folder: str) -> DataFrame:
    creators, _ = scan(
        fixtures.landed_threads(spark, folder),
        fixtures.landed_pages(spark, folder),
        fixtures.INGEST_TIME,
        scratch_path(spark, "scan"),
    )
    return creators.withColumn("last_scanned", F.date_format("last_scanned", fixed.TIMESTAMP_FORMAT))


def detect_platform(spark: SparkSession, folder: str) -> DataFrame:
    urls = read_table(spark, folder, "pages", "url").withColumnRenamed("url", "profile_url")
    urls = urls.unionByName(fixtures.links(spark, folder).select("profile_url")).distinct()
    return urls.select("profile_url", platform_of(F.col("profile_url")).alias("platform"))


def extract_handle(spark: SparkSession, folder: str) -> DataFrame:
    urls = read_table(spark, folder, "pages", "url").withColumnRenamed("url", "profile_url")
    urls = urls.unionByName(fixtures.links(spark, folder).select("profile_url")).distinct()
    return with_link_parts(urls).select("profile_url", "platform", "handle")


def creator_name_list(spark: SparkSession, folder: str) -> DataFrame:
    """Names of links; every link of one board has a landed title."""
    urls = fixtures.links(spark, folder).select("profile_url")
    titles = urls.filter(F.contains("profile_url", F.lit("/r/gaming/"))).withColumn(
        "title", F.concat(F.lit("Thread "), F.regexp_extract("profile_url", "comments/([^/]+)", 1))
    )
    return creator_names(urls, titles).select("profile_url", "platform", "handle", "creator_name")


def strip_html(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages", "page_id", "html").select(
        "page_id", strip_tags(F.col("html")).alias("text")
    )


def normalise_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as comments in which assistants give no author, and empty timestamps are missing."""
    turns = read_table(spark, folder, "conversations", "conv_id", "turn", "role", "text").select(
        "conv_id",
        "turn",
        F.when(F.col("role") != "assistant", F.col("role")).alias("author"),
        "text",
        F.lit(None).cast("string").alias("timestamp"),
    )
    return normalise(turns)


# --- outside labels ---


def _batched(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    kept = _comments(spark, folder).select("profile_url", "pos", "comment_id", *columns)
    return labels.cut_batches(kept, fixtures.BATCH_ROWS)


def label_batches(spark: SparkSession, folder: str) -> DataFrame:
    return _batched(spark, folder).select("comment_id", "profile_url", "batch_id", "id")


def label_payloads(spark: SparkSession, folder: str) -> DataFrame:
    return labels.label_payloads(_batched(spark, folder, "text")).select("profile_url", "batch_id", "payload", "items")


def label_payload_items(spark: SparkSession, folder: str) -> DataFrame:
    """The payloads read back: what a labeller is given, item by item."""
    sent = label_payloads(spark, folder)
    items = F.from_json("payload", "ARRAY<STRUCT<id: BIGINT, text: STRING>>")
    return sent.select("profile_url", "batch_id", F.inline(items))


def parse_external_labels(spark: SparkSession, folder: str) -> DataFrame:
    parsed = labels.parse_label_payloads(fixtures.landed_labels(spark, folder))
    return labels.label_rows(parsed).select("profile_url", "batch_id", "item", "id", *LABELS)


def external_batch_status(spark: SparkSession, folder: str) -> DataFrame:
    parsed = labels.parse_label_payloads(fixtures.landed_labels(spark, folder))
    return parsed.select("profile_url", "batch_id", "ok")


def merge_external_labels(spark: SparkSession, folder: str) -> DataFrame:
    merged = labels.merge_labels(_batched(spark, folder), fixtures.label_items(spark, folder))
    return merged.select("comment_id", "profile_url", "batch_id", "id", *LABELS)


def hybrid_labels(spark: SparkSession, folder: str) -> DataFrame:
    parsed = labels.parse_label_payloads(fixtures.landed_labels(spark, folder))
    labelled = labels.hybrid_labels(_batched(spark, folder, "text"), parsed)
    return labelled.select("comment_id", "profile_url", "scan_ok", *LABELS)


def stream_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as they arrive, some broken and some too late: every scan is decided by a stateful stream in two rounds, then
    labelled from outside or by the rules."""
    inbox, path, progress = (scratch_path(spark, n) for n in ("answers", "verdicts", "verdicts-progress"))
    events = write_table(fixtures.label_events(spark, folder), scratch_path(spark, "label-events"))
    late = F.col("at") > F.expr(f"timestamp '{fixtures.SENT_AT}' + interval '1' hour")
    for arrived in (events.filter(~late), events.filter(late)):
        arrived.write.mode("append").parquet(inbox)
        landed = spark.readStream.schema(fixtures.LABEL_EVENT).parquet(inbox)
        answers = labels.parse_label_payloads(landed.filter("batches is null"), "scan", "at").drop("labels")
        sent = landed.filter("batches is not null").select("profile_url", "scan", "batches", "at")
        verdicts = drain_verdicts(sent, answers, path, progress, patience_seconds=3600)
    batched = _batched(spark, folder, "text")
    records = labels.batch_records(batched, labels.parse_label_payloads(events.filter("batches is null")))
    labelled = labels.label_by_verdict(batched, records, verdicts.select("profile_url", "scan_ok"))
    return labelled.join(verdicts.select("profile_url", "reason"), "profile_url").select(
        "comment_id", "profile_url", "scan_ok", "reason", *LABELS
    )


# --- tables ---


def scan_comments(spark: SparkSession, folder: str) -> DataFrame:
    return views.newest_first(_comments(spark, folder))


def list_creators(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_creators(spark, folder))


def _shown(creators: DataFrame) -> DataFrame:
    return creators.withColumn("last_scanned", F.date_format("last_scanned", fixed.TIMESTAMP_FORMAT))


def _rescanned(spark: SparkSession, folder: str) -> int:
    """The creators of two platforms scanned again with outside labels, as a generation on top of the first."""
    again = labels.merge_labels(_batched(spark, folder, "author", "text", "timestamp"), fixtures.label_items(spark, folder))
    again = again.filter(platform_of(F.col("profile_url")).isin(*RESCANNED)).select(
        "profile_url", "comment_id", "author", "text", "timestamp", *LABELS
    )
    scanned = _creators(spark, folder).filter(F.col("platform").isin(*RESCANNED))
    return generations.append_scan(spark, fixtures.store(spark, folder), scanned, again, fixtures.INGEST_TIME, of=[0])


def replace_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Rule labels stored; the creators of two platforms scanned again with outside labels."""
    again = _rescanned(spark, folder)
    return generations.current_comments(spark, fixtures.store(spark, folder), [0, again]).select(*views.VIEW_COLUMNS)


def upsert_creators(spark: SparkSession, folder: str) -> DataFrame:
    """Stored creators, then two scans in one batch: known ones under another platform, and one new
    creator for each conversation, scanned twice."""
    stored = fixtures.creators(spark, folder)
    known = stored.filter(F.col("platform").isin(*RESCANNED)).select(
        "profile_url",
        F.lit("Other").alias("platform"),
        F.concat(F.lit("New "), "creator_name").alias("creator_name"),
        F.lit(50.0).alias("safety_score"),
        F.expr("last_scanned + interval '30' day").alias("last_scanned"),
    )
    threads = read_table(spark, folder, "conversations", "conv_id", "turn")
    scanned = threads.select(
        F.concat(F.lit("https://example.org/conv/"), "conv_id").alias("profile_url"),
        F.lit("Other").alias("platform"),
        F.concat(F.lit("Turn "), "turn").alias("creator_name"),
        F.lit(None).cast("double").alias("safety_score"),
        F.expr(f"timestamp '{fixtures.INGEST_TIME}' + turn * interval '1' hour").alias("last_scanned"),
    )
    merged = tables.upsert_creators(stored, known.unionByName(scanned))
    return _shown(tables.write_scores(merged, analytics.safety_scores(_comments(spark, folder))))


def _doomed(spark: SparkSession, folder: str) -> DataFrame:
    return _creators(spark, folder).filter(F.col("platform") == DELETED_PLATFORM)


def delete_creators(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(tables.delete_creators(_creators(spark, folder), _doomed(spark, folder)))


def delete_creator_comments(spark: SparkSession, folder: str) -> DataFrame:
    store = fixtures.store(spark, folder)
    gone = generations.delete(spark, store, _doomed(spark, folder), of=[0])
    left = generations.current_comments(spark, store, [0, gone])
    return left.select("profile_url", "comment_id", "author", "timestamp", *LABELS)


def _changed(spark: SparkSession, folder: str) -> generations.State:
    """The store after a rescan of two platforms and the deletion of a third."""
    store, again = fixtures.store(spark, folder), _rescanned(spark, folder)
    return generations.state(spark, store, [0, again, generations.delete(spark, store, _doomed(spark, folder), of=[0, again])])


def kept_class_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Class counts after a rescan and a deletion, from tallies alone."""
    now = _changed(spark, folder)
    return analytics.class_counts_of_tallies(now.creators(), now.tallies())


def kept_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The roll-up after a rescan and a deletion, with scores kept up to date, from tallies alone."""
    now = _changed(spark, folder)
    known = tables.write_scores(now.creators(), analytics.scores_of_tallies(now.tallies()))
    return _shown(analytics.rollup_of_tallies(known, now.tallies()))


def kept_top_offenders(spark: SparkSession, folder: str) -> DataFrame:
    """Top offenders after a rescan and a deletion, from tallies alone."""
    return analytics.offenders_of_tallies(_changed(spark, folder).tallies())


def stream_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Comments that a stream keeps: landed scans in three micro-batches. The pages of every third link come apart."""
    store, inbox, progress = (scratch_path(spark, n) for n in ("kept", "landed", "landed-progress"))
    landed = write_table(fixtures.landed_scans(spark, folder), scratch_path(spark, "landed-scans"))
    number = F.regexp_extract("profile_url", "src([0-9]+)$", 1).cast("int")
    part = F.when(number % 3 == 0, F.col("page") % 3).otherwise(number % 3)
    for i in range(3):
        landed.filter(part == i).write.mode("append").parquet(inbox)
        keep_tables(spark.readStream.schema(schemas.LANDED_PAGE).parquet(inbox), store, progress, fixtures.INGEST_TIME)
    return generations.current_comments(spark, store).select("profile_url", "pos", "author", "text", "timestamp", *LABELS)


def export_comments_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "export-comments")
    csv_files.pack_comments(views.in_categories(_comments(spark, folder)), path)
    return csv_files.read_pack(spark, path, schemas.EXPORT)


def export_blocklist_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "export-blocklist")
    csv_files.pack_blocklist(analytics.blocklist(_comments(spark, folder)), path)
    return csv_files.read_pack(spark, path, "Username STRING")


# --- reports ---


def safety_scores(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.safety_scores(_comments(spark, folder)).select(*SCORES)


def thread_safety_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of many small creators: each conversation as one."""
    turns = read_table(spark, folder, "conversations", "conv_id", "text")
    url = F.concat(F.lit("https://example.org/conv/"), "conv_id").alias("profile_url")
    return analytics.safety_scores(moderate(turns.select(url, "text"))).select(*SCORES)


def safety_bands(spark: SparkSession, folder: str) -> DataFrame:
    scores = analytics.safety_scores(_comments(spark, folder))
    bands = analytics.safety_bands(scores)
    return bands.select("profile_url", "safety_score", "scan_band", "safety_band", "safety_text")


def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.class_counts(*fixtures.stored_tables(spark, folder))


def external_class_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Class counts with a class that the rules do not know."""
    merged = labels.merge_labels(_batched(spark, folder), fixtures.label_items(spark, folder))
    return analytics.class_distribution(analytics.class_counts(_creators(spark, folder), merged))


def class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.class_distribution(class_counts(spark, folder))


def creator_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(analytics.creator_rollup(*fixtures.stored_tables(spark, folder)))


def external_creator_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Roll-up over outside labels: an unknown class counts as flagged."""
    merged = labels.merge_labels(_batched(spark, folder), fixtures.label_items(spark, folder))
    return _shown(analytics.creator_rollup(_creators(spark, folder), merged))


def top_offenders(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.top_offenders(_comments(spark, folder))


def creator_analytics(spark: SparkSession, folder: str) -> DataFrame:
    bundle = analytics.creator_analytics(*fixtures.stored_tables(spark, folder))
    listed = F.transform("top_offenders", lambda o: F.concat(o["author"], F.lit(":"), o["violations_count"]))
    return bundle.withColumn("top_offenders", F.array_join(listed, ",")).drop("last_scanned", "class_counts")


def external_creator_analytics(spark: SparkSession, folder: str) -> DataFrame:
    """Class counts of the bundle over outside labels, an unknown class among them."""
    merged = labels.merge_labels(_batched(spark, folder, "author"), fixtures.label_items(spark, folder))
    bundle = analytics.creator_analytics(_creators(spark, folder), merged)
    listed = F.transform(F.map_entries("class_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return bundle.select("profile_url", "total_comments", F.array_join(listed, ",").alias("class_counts"), "flagged_issues")


def blocklist(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.blocklist(_comments(spark, folder))


def comments_of_creator(spark: SparkSession, folder: str) -> DataFrame:
    return views.newest_of_creator(_comments(spark, folder), "https://instagram.com/src2")


def comments_of_creators(spark: SparkSession, folder: str) -> DataFrame:
    chosen = _creators(spark, folder).filter(F.col("platform") == "Instagram")
    return views.newest_first(views.of_creators(_comments(spark, folder), chosen))


def comments_by_class(spark: SparkSession, folder: str) -> DataFrame:
    return views.by_class(_comments(spark, folder), [fixed.HARMFUL, fixed.SPAM])


def flagged_view(spark: SparkSession, folder: str) -> DataFrame:
    return views.flagged_view(_comments(spark, folder))


def search_comments(spark: SparkSession, folder: str) -> DataFrame:
    return views.flagged_view(_comments(spark, folder), fixed.CLASSES, SEARCH_TERM)


def search_by_index(spark: SparkSession, folder: str) -> DataFrame:
    """search_comments by the index of trigrams."""
    path = scratch_path(spark, "indexed")
    text_index.write_indexed(_comments(spark, folder).select(*views.VIEW_COLUMNS), path, block_rows=200)
    return text_index.search_indexed(spark, path, SEARCH_TERM)


def comment_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each comment's place in its creator's comments, newest first and gravest first, and the page it is on."""
    found = []
    for order in ordered.ORDERS:
        path = scratch_path(spark, "ordered")
        ordered.write_ordered(_comments(spark, folder).select(*views.VIEW_COLUMNS), path, order, files=16)
        numbered = ordered.numbered(spark, path).withColumn("page", F.expr(f"position div {PAGE_ROWS}"))
        found.append(numbered.select("profile_url", "comment_id", F.lit(order).alias("sorted_by"), "position", "page"))
    return found[0].unionByName(found[1])


def second_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of one creator's comments, after the last comment of the first one."""
    path, link = scratch_path(spark, "ordered"), "https://instagram.com/src2"
    ordered.write_ordered(_comments(spark, folder).select(*views.VIEW_COLUMNS), path, files=16)
    last = ordered.page(spark, path, link, PAGE_ROWS).collect()[-1]
    return ordered.page(spark, path, link, PAGE_ROWS, (last.timestamp, last.comment_id))


def filtered_counts(spark: SparkSession, folder: str) -> DataFrame:
    return views.filtered_counts(*fixtures.stored_tables(spark, folder), term=SEARCH_TERM)


def severity_percent(spark: SparkSession, folder: str) -> DataFrame:
    return views.comment_cards(_comments(spark, folder)).select("comment_id", "severity_score", "severity_percent")


def highlight_triggers(spark: SparkSession, folder: str) -> DataFrame:
    return views.comment_cards(_comments(spark, folder)).select("comment_id", "marked_text")


QUERIES: dict[str, Query] = {
    "hits_harmful": _hits(fixed.HARMFUL_TERMS),
    "hits_abusive": _hits(fixed.ABUSIVE_TERMS),
    "hits_toxic": _hits(fixed.TOXIC_TERMS),
    "hits_spam": _hits(fixed.SPAM_TERMS),
    "detect_url": _text_test("has_link", lambda text: has_link(F.lower(text))),
    "detect_yelling": _text_test("is_yelling", is_yelling),
    "detect_emoji": detect_emoji,
    "classify_emoji": classify_emoji,
    "classify_comments": classify_comments,
    "classify_by_version": classify_by_version,
    "term_places": term_places,
    "classify_turns": classify_turns,
    "moderate_comments": moderate_comments,
    "stream_moderation": stream_moderation,
    "reddit_flatten": reddit_flatten,
    "reddit_flatten_limited": reddit_flatten_limited,
    "landed_status": landed_statuses,
    "youtube_pages": youtube_pages,
    "youtube_flatten": youtube_flatten,
    "scan_links": scan_links,
    "detect_platform": detect_platform,
    "extract_handle": extract_handle,
    "creator_names": creator_name_list,
    "strip_html": strip_html,
    "normalise_comments": normalise_comments,
    "label_batches": label_batches,
    "label_payloads": label_payloads,
    "label_payload_items": label_payload_items,
    "parse_external_labels": parse_external_labels,
    "external_batch_status": external_batch_status,
    "merge_external_labels": merge_external_labels,
    "hybrid_labels": hybrid_labels,
    "stream_labels": stream_labels,
    "scan_comments": scan_comments,
    "list_creators": list_creators,
    "replace_comments": replace_comments,
    "upsert_creators": upsert_creators,
    "delete_creators": delete_creators,
    "delete_creator_comments": delete_creator_comments,
    "kept_class_counts": kept_class_counts,
    "kept_rollup": kept_rollup,
    "kept_top_offenders": kept_top_offenders,
    "stream_tables": stream_tables,
    "export_comments_csv": export_comments_csv,
    "export_blocklist_csv": export_blocklist_csv,
    "safety_scores": safety_scores,
    "thread_safety_scores": thread_safety_scores,
    "safety_bands": safety_bands,
    "class_counts": class_counts,
    "external_class_counts": external_class_counts,
    "class_distribution": class_distribution,
    "creator_rollup": creator_rollup,
    "external_creator_rollup": external_creator_rollup,
    "top_offenders": top_offenders,
    "creator_analytics": creator_analytics,
    "external_creator_analytics": external_creator_analytics,
    "blocklist": blocklist,
    "comments_of_creator": comments_of_creator,
    "comments_of_creators": comments_of_creators,
    "comments_by_class": comments_by_class,
    "flagged_view": flagged_view,
    "search_comments": search_comments,
    "search_by_index": search_by_index,
    "comment_pages": comment_pages,
    "second_page": second_page,
    "filtered_counts": filtered_counts,
    "severity_percent": severity_percent,
    "highlight_triggers": highlight_triggers,
    "highlight_by_places": highlight_by_places,
    "reddit_flatten_deep": reddit_flatten_deep,
}
