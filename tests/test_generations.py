import datetime
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from modlytics import schemas
from modlytics.operators import analytics, generations, tables
from modlytics.session import scratch_path

NOW = "2024-02-01 00:00:00"
VIEW = ["profile_url", "comment_id", "author", "text", "timestamp", "classification", "severity_score", "flagged_words"]
CLASSES = ["Proper", "Spam", "Toxic", "Abusive", "Harmful", "Odd"]


def creators(spark, rows):
    """(link, platform, day)"""
    data = [(u, p, f"{u} {day}", None, datetime.datetime(2024, 1, day)) for u, p, day in rows]
    return spark.createDataFrame(data, schemas.CREATOR)


def comments(spark, rows):
    """(link, id, author, class)"""
    data = [(u, i, i, a, f"text {i}", f"2024-01-01 00:00:{i % 60:02}", c, 0.5, [], "") for u, i, a, c in rows]
    return spark.createDataFrame(data, schemas.MODERATED_COMMENT)


def scanned(spark, chance, links, day, n=6):
    """A scan of links: creators and comments."""
    rows = [(u, chance.randrange(10**9), chance.choice(["ann", "bob", None]), chance.choice(CLASSES)) for u in links for _ in range(n)]
    return creators(spark, [(u, f"p{day}", day) for u in links]), comments(spark, rows)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def listing(spark, path, part="comments"):
    """Files of a part with their sizes and times."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}/generation=*{'/buckets=*/bucket=*' if part == 'comments' else ''}/part-*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return {f.getPath().toString(): (f.getLen(), f.getModificationTime()) for f in found}


def test_scans_and_deletions_as_by_whole_tables(spark, rows):
    """Five rescans and a deletion: the tables and reports are those of rewriting everything and counting it all again."""
    path, chance = scratch_path(spark, "store"), random.Random(4)
    links = [f"https://youtu.be/c{i}" for i in range(12)]
    old_creators, old_comments = creators(spark, []), comments(spark, [])
    plans = [links, links[:3], links[2:7], ["https://youtu.be/new", links[0]], links[5:6], links[:1]]
    for day, some in enumerate(plans, 1):
        new_creators, new_comments = scanned(spark, chance, some, day)
        assert generations.append_scan(spark, path, new_creators, new_comments, NOW) >= day - 1
        old_comments = spark.createDataFrame(
            tables.replace_comments(old_comments, new_comments, NOW, new_creators).collect(), schemas.MODERATED_COMMENT
        )
        old_creators = spark.createDataFrame(tables.upsert_creators(old_creators, new_creators).collect(), schemas.CREATOR)
        if day == 3:
            doomed = spark.createDataFrame([(links[1],), (links[11],), ("https://youtu.be/unknown",), (None,)], "profile_url STRING")
            generations.delete(spark, path, doomed)
            old_comments = spark.createDataFrame(tables.delete_creators(old_comments, doomed).collect(), schemas.MODERATED_COMMENT)
            old_creators = spark.createDataFrame(tables.delete_creators(old_creators, doomed).collect(), schemas.CREATOR)

    def same():
        now = generations.state(spark, path)
        assert rows(now.comments(), *VIEW) == rows(old_comments, *VIEW)
        columns = ["profile_url", "platform", "creator_name", "last_scanned"]
        assert rows(now.creators(), *columns) == rows(old_creators, *columns)
        tallies = now.tallies()
        assert "comments" not in " ".join(tallies.inputFiles())
        assert rows(tallies) == rows(analytics.author_tallies(old_comments))
        assert rows(analytics.scores_of_tallies(tallies)) == rows(analytics.safety_scores(old_comments))
        for report, again in (
            (analytics.class_counts_of_tallies, analytics.class_counts),
            (analytics.rollup_of_tallies, analytics.creator_rollup),
            (analytics.analytics_of_tallies, analytics.creator_analytics),
        ):
            assert rows(report(old_creators, tallies)) == rows(again(old_creators, old_comments))
        assert rows(analytics.offenders_of_tallies(tallies)) == rows(analytics.top_offenders(old_comments))
        return now

    now = same()
    assert now.mixed
    for link in (links[0], links[1], links[8], "https://youtu.be/new", "https://youtu.be/unknown"):
        one = generations.comments_of(spark, path, link)
        assert rows(one, *VIEW) == rows(old_comments.filter(F.col("profile_url") == link), *VIEW)
        assert len({f.split("generation=")[1].split("/")[0] for f in one.inputFiles()}) <= 1
        assert not one.inputFiles() or "(bucket#" in re.search(r"PartitionFilters: \[[^\]]*\]", plan_of(one))[0]
    # Afterwards nothing is joined, and what nobody holds can go.
    assert generations.compact(spark, path) is not None
    assert not same().mixed
    assert generations.compact(spark, path) is None
    gone = generations.vacuum(spark, path)
    assert gone and generations.vacuum(spark, path) == []
    same()
    generations.compact(spark, path, whole=True)
    assert len(same().clean) == 1
    generations.delete(spark, path, old_creators.filter("profile_url like '%new'"))
    assert rows(generations.current_creators(spark, path), "profile_url") == rows(old_creators.filter("profile_url not like '%new'"), "profile_url")


def test_one_of_many_creators_is_replaced_by_writing_its_rows_only(spark):
    path, chance = scratch_path(spark, "store"), random.Random(5)
    links = [f"c{i}" for i in range(300)]
    generations.append_scan(spark, path, *scanned(spark, chance, links, 1, 2), NOW)
    before = listing(spark, path)
    generations.append_scan(spark, path, *scanned(spark, chance, ["c7"], 2, 2), NOW)
    after = listing(spark, path)
    assert {k: after[k] for k in before} == before and len(after) - len(before) == 1
    assert spark.read.parquet(*(set(after) - set(before))).count() == 2
    generations.delete(spark, path, spark.createDataFrame([("c8",)], "profile_url STRING"))
    assert listing(spark, path) == after
    assert generations.current_comments(spark, path).count() == 598


def test_what_was_not_finished_is_not_seen(spark, rows):
    path, chance = scratch_path(spark, "store"), random.Random(6)
    first = scanned(spark, chance, ["a", "b"], 1)
    generations.append_scan(spark, path, *first, NOW)
    lost = scanned(spark, chance, ["a"], 2)
    staged = generations.stage(spark, path, lost[1], NOW)  # and then the job dies
    assert staged.generation == 1 and rows(generations.current_comments(spark, path), "comment_id") == rows(first[1], "comment_id")
    again = scanned(spark, chance, ["b"], 3)
    assert generations.append_scan(spark, path, *again, NOW) == 1
    want = rows(first[1].filter("profile_url = 'a'").unionByName(again[1]), "comment_id")
    assert rows(generations.current_comments(spark, path), "comment_id") == want
    # A list of generations hides the others.
    assert rows(generations.current_comments(spark, path, [0]), "comment_id") == rows(first[1], "comment_id")


def test_defined_cases(spark, rows):
    path = scratch_path(spark, "store")
    assert generations.generations(spark, path) == [] and generations.current_comments(spark, path).count() == 0
    assert generations.current_creators(spark, path).count() == 0 and generations.current_tallies(spark, path).count() == 0
    assert generations.comments_of(spark, path, "a").count() == 0
    nothing = creators(spark, []), comments(spark, [])
    generations.append_scan(spark, path, *nothing, NOW)
    generations.delete(spark, path, nothing[0])
    assert generations.current_comments(spark, path).count() == 0
    loose = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "profile_url STRING, comment_id BIGINT, extra STRING")
    both = creators(spark, [("a", "p", 1), ("empty", "p", 1)]).unionByName(creators(spark, [(None, "p", 1)]))
    generations.append_scan(spark, path, both, loose.withColumns({c: F.lit(None).cast("string") for c in ("author", "text", "timestamp", "classification", "flagged_words")}).withColumn("severity_score", F.lit(None).cast("double")), NOW)
    assert rows(generations.current_comments(spark, path), *VIEW) == [("a", 1, "Anonymous", "", NOW, "Proper", 0.0, "")]
    assert rows(generations.current_creators(spark, path), "profile_url") == [("a",), ("empty",)]


def test_progress_of_streams(spark):
    path, chance = scratch_path(spark, "store"), random.Random(7)
    assert generations.applied(spark, path, "x") == -1
    generations.append_scan(spark, path, *scanned(spark, chance, ["a"], 1), NOW, batch=("x", 0))
    generations.append_scan(spark, path, *scanned(spark, chance, ["b"], 1), NOW, batch=("y", 4))
    generations.append_scan(spark, path, *scanned(spark, chance, ["a"], 2), NOW)
    generations.append_scan(spark, path, *scanned(spark, chance, ["a"], 2), NOW, batch=("x", 1))
    generations.compact(spark, path)
    generations.vacuum(spark, path)
    assert [generations.applied(spark, path, s) for s in "xyz"] == [1, 4, -1]


def test_a_hot_creator_is_split_over_files(spark):
    """With small partitions, a creator of two thirds of all rows is written by several tasks."""
    path = scratch_path(spark, "store")
    many = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("profile_url"), F.col("id").alias("comment_id"),
        F.concat(F.lit("a"), F.col("id") % 9).alias("author"), F.sha2(F.col("id").cast("string"), 512).alias("text"),
        F.lit("t").alias("timestamp"), F.lit("Spam").alias("classification"), F.lit(0.4).alias("severity_score"), F.lit("").alias("flagged_words"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        staged = generations.stage(spark, path, many, NOW)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    holders = Counter(f.rsplit("/", 1)[0] for f in staged.comments.filter("profile_url = 'hot'").select(F.input_file_name().alias("f")).distinct().toPandas().f)
    assert len(holders) == 1 and max(holders.values()) > 3
    assert staged.comments.count() == 30_000


def test_bucket_count_is_the_tables(spark, rows):
    """Tables with another number of buckets than usual are read and changed rightly; a wrong expectation is an error."""
    from modlytics.operators.views import newest_of_creator
    from modlytics.sources.tables import write_comments

    path = scratch_path(spark, "bucketed")
    table = write_comments(comments(spark, [(f"c{i}", i, "x", "Spam") for i in range(40)]), path, 8)
    for i in range(40):
        one = newest_of_creator(table, f"c{i}")
        assert rows(one, "comment_id") == [(i,)] and "(bucket#" in re.search(r"PartitionFilters: \[[^\]]*\]", plan_of(one))[0]
    for i in range(10):
        table = tables.replace_in_table(spark, path, comments(spark, [(f"c{i}", 100 + i, "y", "Toxic")]), NOW)
    assert rows(table, "comment_id") == sorted([(100 + i,) for i in range(10)] + [(i,) for i in range(10, 40)], key=lambda r: str(r[0]))
    with pytest.raises(ValueError, match="8 buckets"):
        tables.delete_from_table(spark, path, comments(spark, [("c3", 1, "x", "Spam")]), 64)
