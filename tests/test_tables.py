import datetime
import json

from pyspark.sql import functions as F

from modlytics import schemas
from modlytics.operators.labels import parse_label_payloads
from modlytics.operators.positions import dense_positions
from modlytics.operators.tables import delete_creators, delete_from_table, replace_comments, replace_in_table, upsert_creators, write_scores
from modlytics.plans.scan import label_requests, next_tables, raw_comments, scan
from modlytics.plans.fixtures import INGEST_TIME, landed_pages, landed_threads
from modlytics.session import scratch_path
from modlytics.sources.tables import write_comments, write_table


def at(day):
    return datetime.datetime(2024, 1, day)


def creators(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.CREATOR)


def moderated(spark, *rows):
    data = [(url, i, i, author, text, None, label, severity, [], "") for url, i, author, text, label, severity in rows]
    return spark.createDataFrame(data, schemas.MODERATED_COMMENT)


def test_upsert(spark, rows):
    old = creators(spark, ("a", "Reddit", "A", 90.0, at(1)), ("b", "TikTok", "B", 80.0, at(1)))
    new = creators(
        spark,
        ("a", "Other", "A2", 70.0, at(3)),
        ("a", "Other", "A1", 60.0, at(2)),
        ("c", "YouTube", "C", None, at(2)),
    )
    once = upsert_creators(old, new)
    expected = [
        ("a", "Reddit", "A2", 70.0, at(3)),
        ("b", "TikTok", "B", 80.0, at(1)),
        ("c", "YouTube", "C", 100.0, at(2)),
    ]
    assert rows(once) == expected
    assert rows(upsert_creators(once, new)) == expected


def test_scores_are_written_to_their_creators(spark, rows):
    old = creators(spark, ("a", "Reddit", "A", 90.0, at(1)), ("b", "TikTok", "B", 80.0, at(1)))
    scores = spark.createDataFrame([("a", 12.5), ("z", 1.0)], "profile_url STRING, safety_score DOUBLE")
    assert rows(write_scores(old, scores), "profile_url", "safety_score") == [("a", 12.5), ("b", 80.0)]


def test_replace(spark, rows):
    old = moderated(spark, ("a", 1, "x", "old", "Spam", 0.5), ("b", 2, "x", "old", "Spam", 0.5))
    new = moderated(spark, ("a", 3, None, None, "Toxic", None), ("a", 4, "y", "new", "Toxic", 0.6))
    once = replace_comments(old, new, "now")
    columns = ["profile_url", "comment_id", "author", "text", "timestamp", "classification", "severity_score"]
    expected = [
        ("a", 3, "Anonymous", "", "now", "Toxic", 0.0),
        ("a", 4, "y", "new", "now", "Toxic", 0.6),
        ("b", 2, "x", "old", None, "Spam", 0.5),
    ]
    assert rows(once, *columns) == expected
    assert rows(replace_comments(once, new, "now"), *columns) == expected
    nothing = old.filter("false")
    assert rows(replace_comments(old, nothing, "now"), "comment_id") == [(1,), (2,)]


def test_delete(spark, rows):
    table = creators(spark, ("a", "Reddit", "A", 90.0, at(1)), ("b", "TikTok", "B", 80.0, at(1)))
    doomed = spark.createDataFrame([("b",), ("b",), ("q",)], "profile_url STRING")
    assert rows(delete_creators(table, doomed), "profile_url") == [("a",)]


def test_positions_of_a_hot_group(spark):
    """One group has two thirds of the rows and spans many slabs; ids have gaps."""
    ids = spark.range(3000).select((F.col("id") * 3 + F.col("id") % 2).alias("n"))
    owned = ids.withColumn("g", F.when(F.col("n") % 3 != 0, "hot").otherwise(F.concat(F.lit("g"), F.col("n") % 5)))
    mixed = owned.withColumn("g", F.when(F.xxhash64("n") % 3 != 0, "hot").otherwise(F.col("g")))
    got = dense_positions(mixed, "g", "n").toPandas().sort_values(["g", "n"])
    assert list(got.pos) == list(got.groupby("g").cumcount())
    assert len(got) == 3000 and (got.g == "hot").mean() > 0.6


def test_positions_of_hashed_ids(spark):
    hashed = spark.range(2000).select(F.xxhash64("id").alias("n"), F.when(F.col("id") % 3 == 0, "hot").otherwise("g").alias("g"))
    got = dense_positions(hashed, "g", "n").toPandas().sort_values(["g", "n"])
    assert list(got.pos) == list(got.groupby("g").cumcount()) and len(got) == 2000


def test_touched_buckets_only(spark, rows):
    """Replacing and deleting in a bucketed table leaves the files of other creators' buckets alone."""
    path = scratch_path(spark, "bucketed")
    old = moderated(spark, *[(f"c{i}", i, "x", "old", "Spam", 0.5) for i in range(20)])
    table = write_comments(old, path, 8)
    number = {r.profile_url: r.bucket for r in table.collect()}

    def files(but):
        return {f for f in spark.read.parquet(path).inputFiles() if f"bucket={but}/" not in f}

    before = files(number["c3"])
    new = moderated(spark, ("c3", 100, "y", "new", "Toxic", 0.6), ("c3", 101, "y", "new", "Toxic", 0.6))
    after = replace_in_table(spark, path, new, "now", buckets=8)
    assert files(number["c3"]) == before
    expected = sorted([(f"c{i}", i) for i in range(20) if i != 3] + [("c3", 100), ("c3", 101)])
    assert rows(after, "profile_url", "comment_id") == expected
    gone = [c for c, b in number.items() if b == number["c3"]]
    left = delete_from_table(spark, path, spark.createDataFrame([(c,) for c in gone], "profile_url STRING"), 8)
    assert files(number["c3"]) == before == set(spark.read.parquet(path).inputFiles())
    assert rows(left, "profile_url", "comment_id") == [e for e in expected if e[0] not in gone]


def test_scan_with_titles_and_outside_labels(spark):
    threads = spark.createDataFrame([], schemas.LANDED_PAYLOAD)
    item = {"snippet": {"topLevelComment": {"snippet": {"textDisplay": "damn <b>fine</b>"}}}}
    urls = ["https://youtu.be/one", "https://youtu.be/two"]
    pages = spark.createDataFrame([(u, json.dumps({"items": [item] * 60})) for u in urls], schemas.LANDED_PAYLOAD)
    details = spark.createDataFrame(
        [(urls[0], json.dumps({"items": [{"snippet": {"title": "A film"}}]}))], schemas.LANDED_PAYLOAD
    )
    sent = label_requests(raw_comments(threads, pages, "now")).collect()
    assert sorted((r.profile_url, r.batch_id, r["items"]) for r in sent) == [
        (u, b, n) for u in urls for b, n in ((0, 50), (1, 10))
    ]
    # The labeller finds nothing wrong, but its second answer on one creator is broken.
    answers = [(r.profile_url, r.batch_id, "[" if (r.profile_url, r.batch_id) == (urls[1], 1) else "[]") for r in sent]
    landed = spark.createDataFrame(answers, "profile_url STRING, batch_id BIGINT, payload STRING")
    path = scratch_path(spark, "scan")
    creators_found, comments_found = scan(threads, pages, INGEST_TIME, path, details, parse_label_payloads(landed))
    got = {r.profile_url: (r.platform, r.creator_name, r.safety_score) for r in creators_found.collect()}
    assert got == {urls[0]: ("YouTube", "A film", 100.0), urls[1]: ("YouTube", "YouTube Video: two", 0.0)}
    classes = comments_found.groupBy("profile_url", "classification").count().collect()
    assert sorted(tuple(r) for r in classes) == [(urls[0], "Proper", 60), (urls[1], "Toxic", 60)]


def test_scan_and_next_tables(spark, small, rows):
    threads, pages = landed_threads(spark, small), landed_pages(spark, small)
    new_creators, found = scan(threads, pages, INGEST_TIME, scratch_path(spark, "scan"))
    known = write_table(new_creators, scratch_path(spark, "scan-creators"))
    assert known.count() == found.select("profile_url").distinct().count()
    assert found.select("comment_id").distinct().count() == found.count()
    victim = known.orderBy("profile_url").first().profile_url
    old = found.filter(F.col("profile_url") == victim).withColumn("text", F.lit("old"))
    kept = found.limit(1).withColumns({"profile_url": F.lit("kept"), "text": F.lit("old")})
    creators_after, comments_after = next_tables(known.limit(0), old.unionByName(kept), known, found, INGEST_TIME)
    assert creators_after.count() == known.count()
    assert comments_after.count() == found.count() + 1
    assert rows(comments_after.filter("text = 'old'"), "profile_url") == [("kept",)]
