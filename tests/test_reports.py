import datetime
import os

from pyspark.sql import functions as F

from modlytics import schemas
from modlytics.functions import dictionary as fixed
from modlytics.operators import analytics, views
from modlytics.plans.fixtures import stored_tables
from modlytics.plans.reports import dashboard, export, manage
from modlytics.session import scratch_path
from modlytics.sources.csv_files import export_comments, read_export, read_export_of


def tables(spark):
    """Creator a has a hot author and an unknown class, b only proper comments, c none."""
    when = datetime.datetime(2024, 1, 2, 3, 4, 5)
    creators = spark.createDataFrame(
        [(u, "Other", u.upper(), 50.0, when + datetime.timedelta(days=i)) for i, u in enumerate("abc")], schemas.CREATOR
    )
    comments = [("a", f"w{i % 7}", "Toxic", 0.6) for i in range(21)]
    comments += [("a", "hot", "Spam", 0.5)] * 40 + [("a", "hot", "Proper", 0.0)] * 30
    comments += [("a", "odd", "Odd", 0.3)] * 2 + [("a", "rude", "Abusive", 0.9), ("a", "bad", "Harmful", 1.0)]
    comments += [("b", "kind", "Proper", 0.0)] * 5
    data = [
        (u, i, i, author, f"text {i}", f"2024-01-01 00:{i % 60:02}:00", label, severity, [], "")
        for i, (u, author, label, severity) in enumerate(comments)
    ]
    return creators, spark.createDataFrame(data, schemas.MODERATED_COMMENT)


def test_scores_and_counts(spark, rows):
    creators, comments = tables(spark)
    assert rows(analytics.safety_scores(comments)) == [("a", 30, 95, 31.6), ("b", 5, 5, 100.0)]
    counts = {(r[0], r[1]): r[2] for r in analytics.class_counts(creators, comments).collect()}
    assert counts["a", "Odd"] == 2 and counts["c", "Harmful"] == 0 and counts["b", "Proper"] == 5
    assert len(counts) == 16
    chart = analytics.class_distribution(analytics.class_counts(creators, comments)).collect()
    assert [r.classification for r in chart if r.profile_url == "a"] == [*fixed.CHART_ORDER, "Odd"]


def test_rollup(spark):
    got = [
        (r.profile_url, r.total_comments, r.flagged_comments, r.dashboard_label)
        for r in analytics.creator_rollup(*tables(spark)).collect()
    ]
    assert got == [
        ("c", 0, 0, "C (Other - Safety: 50.0%)"),
        ("b", 5, 0, "B (Other - Safety: 50.0%)"),
        ("a", 95, 65, "A (Other - Safety: 50.0%)"),
    ]


def test_offenders_and_blocklist(spark, rows):
    _, comments = tables(spark)
    got = [(r.author, r.violations_count) for r in analytics.top_offenders(comments).orderBy("place").collect()]
    assert got == [("hot", 40), ("w0", 3), ("w1", 3), ("w2", 3), ("w3", 3)]
    assert rows(analytics.blocklist(comments)) == [("a", "bad"), ("a", "hot"), ("a", "rude")]


def test_analytics(spark):
    bundle = {r.profile_url: r for r in analytics.creator_analytics(*tables(spark)).collect()}
    a, c = bundle["a"], bundle["c"]
    assert (a.total_comments, a.proper_comments, a.spam_comments, a.flagged_issues) == (95, 30, 40, 63)
    assert [(o.author, o.violations_count) for o in a.top_offenders][:2] == [("hot", 40), ("w0", 3)]
    assert a.last_scanned_text == "2024-01-02 03:04" and a.safety_band == "orange" and a.scan_band == "amber"
    assert (c.total_comments, c.flagged_issues, c.top_offenders) == (0, 0, [])
    assert len(bundle) == 3 and c.class_counts == {}


def test_analytics_count_unknown_classes(spark):
    creators, comments = tables(spark)
    odd = comments.withColumn("classification", F.when(F.col("classification") == "Spam", "LowQuality").otherwise(F.col("classification")))
    for r in analytics.creator_analytics(creators, odd).collect():
        assert sum(r.class_counts.values()) == r.total_comments and "Spam" not in r.class_counts
        assert r.profile_url != "a" or r.class_counts["LowQuality"] == 40


def test_invariants_on_stored_tables(spark, small):
    creators, comments = stored_tables(spark, small)
    bundle = analytics.creator_analytics(creators, comments).collect()
    assert sum(r.total_comments for r in bundle) == comments.count()
    for r in bundle:
        assert r.proper_comments + r.flagged_issues == r.total_comments
    rollup, _ = dashboard(creators, comments)
    assert {r.profile_url: r.flagged_comments for r in rollup.collect()} == {r.profile_url: r.flagged_issues for r in bundle}
    offenders = comments.filter("classification != 'Proper'").select("profile_url", "author")
    assert analytics.blocklist(comments).exceptAll(offenders.distinct()).count() == 0


def test_views(spark):
    _, comments = tables(spark)
    assert views.in_categories(comments).count() == 63
    assert views.in_categories(comments, []).count() == 0
    assert views.by_class(comments, []).count() == views.by_class(comments).count() == 100
    graver = [r.severity_score for r in views.by_class(comments.coalesce(1), ["Harmful", "Spam"]).collect()]
    assert graver == sorted(graver, reverse=True) and len(graver) == 41
    times = [r.timestamp for r in views.newest_of_creator(comments, "b").collect()]
    assert times == sorted(times, reverse=True) and len(times) == 5
    assert views.search(comments, "TEXT 1$").count() == 1
    assert views.search(comments).count() == 100
    counted = {r[0]: r[1] for r in views.filtered_counts(*tables(spark), ["Proper"], "text [0-9]+").collect()}
    assert counted == {"a": 30, "b": 5, "c": 0}
    chosen = spark.createDataFrame([("b",), ("b",)], "profile_url STRING")
    assert views.of_creators(comments, chosen).count() == 5


def test_manage(spark, small):
    _, comments = stored_tables(spark, small)
    cards = manage(comments, ["Toxic", "Abusive"]).collect()
    assert cards and all("<mark>" in r.marked_text and r.severity_percent > 0 for r in cards)


def _files(folder):
    parts = sorted(os.path.join(at, f) for at, _, names in os.walk(folder) for f in names if f.endswith(".csv"))
    return [open(f, newline="").read() for f in parts]


def test_csv_text(spark):
    texts = ['a "q", b\nnl', " blank at the ends ", "back\\slash", "", 'ends with "', "# hash", "a\rb"]
    data = [("ann", t, "2024-01-01 00:00:00", "Spam", 0.5, "") for t in texts]
    comments = spark.createDataFrame(data, schemas.EXPORT).withColumn("profile_url", F.lit("https://x.com/a?b=1")).coalesce(1)
    path = scratch_path(spark, "csv")
    export_comments(comments, path)
    written = "".join(_files(path))
    assert written.startswith("author,text,timestamp,classification,severity_score,flagged_words\n")
    assert 'ann,"a ""q"", b\nnl",2024-01-01 00:00:00,Spam,0.5,\n' in written
    assert "ann, blank at the ends ,2024" in written and "ann,back\\slash,2024" in written and "ann,,2024" in written
    back = read_export(spark, path, schemas.EXPORT).collect()
    assert sorted(r.text for r in back) == sorted(texts) and {r.creator for r in back} == {"https://x.com/a?b=1"}


def test_export(spark, small):
    _, comments = stored_tables(spark, small)
    folder = scratch_path(spark, "export")
    export(comments, folder, term="a")
    shown = views.flagged_view(comments, term="a").select(*schemas.EXPORT_COLUMNS, "profile_url")
    back = read_export(spark, f"{folder}/comments", schemas.EXPORT)
    assert back.exceptAll(shown).count() == 0 and back.count() == shown.count()
    handles = read_export(spark, f"{folder}/blocklist", "Username STRING")
    expected = analytics.blocklist(comments).select("author", "profile_url")
    one = "https://x.com/src3"
    alone = read_export_of(spark, f"{folder}/blocklist", "Username STRING", one)
    assert {r.Username for r in alone.collect()} == {r.author for r in expected.filter(F.col("profile_url") == one).collect()}
    assert "PartitionFilters: [(coalesce(creator" in alone._jdf.queryExecution().executedPlan().toString()
    assert handles.exceptAll(expected).count() == 0 and handles.count() == expected.count()
