"""What the plans must and must not contain."""

import pytest

from modlytics.operators import analytics, views
from modlytics.operators.labels import batch_records, cut_batches, hybrid_labels, parse_label_payloads
from modlytics.operators.moderation import moderate
from modlytics.plans.catalog import QUERIES
from modlytics.plans.fixtures import landed_labels, landed_threads, raw_comments, stored_tables
from modlytics.session import scratch_path
from modlytics.sources.tables import write_table
from modlytics.sources.threads import thread_comments

SEARCH = "ArrowEvalPython"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df):
    df.collect()
    return physical(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_rowwise_python_and_no_product(spark, small, name):
    plan = physical(QUERIES[name](spark, small))
    assert plan.count(SEARCH) <= 1
    for word in ("BatchEvalPython", "InPandas", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(spark, small):
    _, comments = stored_tables(spark, small)
    plan = physical(views.by_class(views.of_creator(comments, "https://x.com/src3"), ["Spam", "Toxic"]))
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(profile_url,https://x.com/src3)" in plan and "In(classification, [Spam,Toxic])" in plan
    plan = physical(analytics.safety_scores(comments))
    assert "ReadSchema: struct<profile_url:string,classification:string>" in plan


def test_rules_run_once_under_filters(spark, small):
    labelled = moderate(raw_comments(spark, small))
    plan = physical(labelled.filter("classification != 'Proper' AND severity_score > 0.5").select("flagged_words"))
    assert plan.count(SEARCH) == 1
    assert physical(analytics.top_offenders(labelled)).count(SEARCH) == 1


def test_analytics_read_the_comments_once(spark, small):
    plan = executed(analytics.creator_analytics(*stored_tables(spark, small)))
    assert "ReusedExchange" in plan


def test_top_offenders_are_cut_before_the_shuffle(spark, small):
    plan = physical(analytics.top_offenders(stored_tables(spark, small)[1]))
    assert plan.count("WindowGroupLimit") == 2


def test_rules_need_no_shuffle(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    assert "Exchange" not in physical(moderate(documents))


def test_threads_stay_in_their_row(spark, small):
    """Above the payloads there is no shuffle and nothing kept, and payloads are parsed once."""
    landed = landed_threads(spark, small)
    stored = landed.write.mode("overwrite").parquet
    path = scratch_path(spark, "threads")
    stored(path)
    plan = physical(thread_comments(spark.read.parquet(path), "2024-02-01 00:00:00"))
    assert "Exchange" not in plan and "ExistingRDD" not in plan
    assert plan.count("posexplode") == 1 and plan.count("aggregate(") == 1


def test_views_of_many_creators_do_not_shuffle_texts(spark, small):
    _, comments = stored_tables(spark, small)
    assert "Exchange" not in physical(views.flagged_view(comments))


def test_hybrid_labels_read_comments_twice_and_answers_once(spark, small):
    """Counted over all jobs: the records of the batches are written by one of them."""
    _, comments = stored_tables(spark, small)
    answers = write_table(parse_label_payloads(landed_labels(spark, small)), scratch_path(spark, "answers"))
    batched = cut_batches(comments.select("profile_url", "pos", "comment_id", "text"), 20)
    records = batch_records(batched, answers)
    assert records.inputFiles() and not set(records.inputFiles()) & set(answers.inputFiles())
    plan = physical(hybrid_labels(batched, answers))
    assert plan.count("FileScan") == 3  # the comments, and the written records for flags and for labels
