import datetime
import json
import random
from urllib.parse import quote

from pyspark.sql import functions as F

from modlytics import schemas
from modlytics.operators import generations
from modlytics.operators.moderation import LABEL_COLUMNS, moderate, normalise
from modlytics.plans import catalog
from modlytics.session import scratch_path
from modlytics.streaming.answers import drain_verdicts
from modlytics.streaming.live import drain, moderate_stream
from modlytics.streaming.tables import keep_folder, settle


def test_stream_equals_batch_and_goes_on(spark, small):
    inbox, out, progress = (scratch_path(spark, n) for n in ("inbox", "out", "progress"))
    documents = spark.read.parquet(f"{small}/documents.parquet")
    raw = documents.select(
        F.col("source").alias("profile_url"),
        F.col("doc_id").alias("comment_id"),
        F.lit(None).cast("bigint").alias("pos"),
        F.when(F.col("lang") == "en", "ann").alias("author"),
        "text",
        F.lit("2024-01-01 00:00:00").alias("timestamp"),
    )
    halves = [raw.filter("comment_id < 120"), raw.filter("comment_id >= 120")]
    seen = 0
    for half in halves:
        half.write.mode("append").parquet(inbox)
        landed = spark.readStream.schema(schemas.RAW_COMMENT).parquet(inbox)
        drain(moderate_stream(landed, 4), out, progress)
        got = spark.read.parquet(out)
        assert got.count() > seen
        seen = got.count()
    drain(moderate_stream(landed, 4), out, progress)
    columns = ["comment_id", "author", "text", *LABEL_COLUMNS]
    batch = moderate(normalise(raw)).select(*columns)
    streamed = spark.read.parquet(out).select(*columns)
    assert streamed.count() == batch.count() and streamed.exceptAll(batch).count() == 0


def test_a_table_streams_as_one_file_or_as_a_folder_of_files(spark, rows, tmp_path):
    docs = spark.createDataFrame([(1, "hello"), (2, "fuck you"), (2, "fuck you"), (None, None)], "doc_id BIGINT, text STRING")
    docs.coalesce(1).write.parquet(str(tmp_path / "one" / "written"))
    next((tmp_path / "one" / "written").glob("part-*")).rename(tmp_path / "one" / "documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.limit(1).write.parquet(str(tmp_path / "many" / "labels.parquet"))
    want = rows(moderate(docs), "doc_id", "classification")
    for layout in ("one", "many"):
        assert rows(catalog.stream_moderation(spark, str(tmp_path / layout)), "doc_id", "classification") == want


def page(*texts):
    items = [{"snippet": {"topLevelComment": {"snippet": {"authorDisplayName": "ann", "textDisplay": t, "publishedAt": "2024-01-01T00:00:00Z"}}}} for t in texts]
    return json.dumps({"items": items})


def thread(title, *bodies):
    nodes = [{"kind": "t1", "data": {"author": "bob", "body": b, "created_utc": 1.0}} for b in bodies]
    return json.dumps([{"data": {"children": [{"data": {"title": title}}]}}, {"data": {"children": nodes}}])


REDDIT, VIDEO, OTHER = "https://www.reddit.com/r/x/comments/1/t/", "https://youtu.be/v", "https://youtu.be/w"
DAY = [datetime.datetime(2024, 1, d) for d in range(1, 6)]
LANDED = [
    [(VIDEO, DAY[1], 0, page("one", "damn")), (REDDIT, DAY[1], 0, thread("Talk", "hello", "fuck you")), (OTHER, DAY[3], 0, page("late one"))],
    # Another page of the same scan, a page landed twice, an older scan of another link, and a broken payload.
    [(VIDEO, DAY[1], 1, page("two")), (VIDEO, DAY[1], 0, page("one", "damn")), (OTHER, DAY[2], 0, page("old")), (REDDIT, DAY[0], 0, "{")],
    # A later scan with fewer pages, one without comments, one of unknown time, and a payload of nobody.
    [(VIDEO, DAY[2], 0, page("three")), (OTHER, DAY[4], 0, page()), (REDDIT, None, 0, thread("Lost", "x")), (None, DAY[2], 0, page("nobody"))],
]
KEPT = ["profile_url", "pos", "author", "text", "timestamp", "classification"]
WANT = [
    (REDDIT, 0, "u/bob", "hello", "1970-01-01 00:00:01", "Proper"),
    (REDDIT, 1, "u/bob", "fuck you", "1970-01-01 00:00:01", "Toxic"),
    (VIDEO, 0, "ann", "three", "2024-01-01 00:00:00", "Proper"),
    (OTHER, 0, "ann", "late one", "2024-01-01 00:00:00", "Proper"),
]


def test_micro_batches_leave_the_tables_of_scans_one_after_another(spark, rows):
    store = scratch_path(spark, "store")
    for batch in (0, 1, 1, 2, 2, 0):
        landed = spark.createDataFrame(LANDED[batch], schemas.LANDED_PAGE)
        before = generations.generations(spark, store)
        made = settle(spark, store, landed, batch, "2024-02-01 00:00:00")
        assert (made is None) == (generations.generations(spark, store) == before)
        if batch == 1:
            texts = rows(generations.current_comments(spark, store).filter(F.col("profile_url") == VIDEO), "text")
            assert texts == [("damn",), ("one",), ("two",)]
    got = rows(generations.current_comments(spark, store), *KEPT)
    assert got == sorted(WANT, key=lambda r: tuple((True, str(v)) for v in r))
    names = rows(generations.current_creators(spark, store), "profile_url", "platform", "creator_name", "safety_score")
    assert (REDDIT, "Reddit", "Talk", 50.0) in names and len(names) == 3


def test_a_repeated_batch_overwrites_what_a_failure_left(spark, rows, monkeypatch):
    store, now = scratch_path(spark, "store"), "2024-02-01 00:00:00"
    landed = spark.createDataFrame(LANDED[0], schemas.LANDED_PAGE)
    whole = generations.commit

    def dies(*_, **__):
        raise RuntimeError("lost")

    monkeypatch.setattr(generations, "commit", dies)
    try:
        settle(spark, store, landed, 0, now)
    except RuntimeError:
        pass
    monkeypatch.setattr(generations, "commit", whole)
    assert generations.current_comments(spark, store).count() == 0
    assert settle(spark, store, landed, 0, now) == 0
    assert generations.current_comments(spark, store).count() == 5


def test_landed_folders_as_a_stream(spark, rows, tmp_path):
    """Folders of payload files in three rounds give the tables of reading them as one batch after another."""
    inbox, store, progress = tmp_path / "landed", scratch_path(spark, "store"), scratch_path(spark, "progress")
    for batch in LANDED:
        for url, at, number, payload in batch:
            if url and at:
                folder = inbox / f"scan={quote(str(at), safe='')}" / f"link={quote(url, safe='')}"
                folder.mkdir(parents=True, exist_ok=True)
                if not (folder / f"{number}.json").exists():
                    (folder / f"{number}.json").write_text(payload)
        keep_folder(spark, str(inbox), store, progress, lambda batch: f"2024-02-0{batch + 1} 00:00:00")
    assert rows(generations.current_comments(spark, store), *KEPT) == sorted(WANT, key=lambda r: tuple((True, str(v)) for v in r))


EVENT = "profile_url STRING, scan STRING, batches LONG, batch_id LONG, ok BOOLEAN, at TIMESTAMP"


def test_verdicts_do_not_depend_on_the_order_of_arrival(spark):
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    sent = [("good", 3), ("broken", 2), ("late", 2), ("silent", 1), ("twice", 2), ("stray", 1)]
    events = [(u, "s", n, None, None, at(0)) for u, n in sent]
    events += [("good", "s", None, i, True, at(10 * i)) for i in range(3)] + [("good", "t", None, 0, False, at(1))]
    events += [("broken", "s", None, 0, True, at(1)), ("broken", "s", None, 1, False, at(2))]
    events += [("late", "s", None, 0, True, at(1)), ("late", "s", None, 1, True, at(61))]
    events += [("twice", "s", None, 0, True, at(1)), ("twice", "s", None, 0, True, at(2)), ("twice", "s", None, 1, True, at(3))]
    events += [("stray", "s", None, 5, False, at(1)), ("stray", "s", None, 0, True, at(60))]
    want = {"good": "complete", "broken": "broken", "late": "late", "silent": "late", "twice": "complete", "stray": "complete"}
    for seed in range(1):
        random.Random(seed).shuffle(events)
        inbox, path, progress = (scratch_path(spark, n) for n in ("events", "verdicts", "progress"))
        rounds = [events[:8], events[8:], [("clock", "s", 1, None, None, at(200))]]
        for some in rounds:
            spark.createDataFrame(some, EVENT).write.mode("append").parquet(inbox)
            landed = spark.readStream.schema(EVENT).parquet(inbox)
            found = drain_verdicts(
                landed.filter("batches is not null"), landed.filter("batches is null").drop("batches"), path, progress, 3600, "2 hours"
            )
        got = [(r.profile_url, r.scan, r.reason, r.scan_ok) for r in found.collect()]
        assert sorted(got) == sorted((u, "s", r, r == "complete") for u, r in want.items())
