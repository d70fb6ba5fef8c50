import hashlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from modlytics.llm import mixing


def key(doc_id):
    name = mixing.SEED if doc_id is None else f"{mixing.SEED}:{doc_id}"
    return hashlib.md5(name.encode()).hexdigest()


def rows_of(df):
    return [(r["doc_id"], r["source"], r["text"]) for r in df.collect()]


def check(df):
    got = sorted((tuple(r) for r in mixing.mix(df).collect()), key=str)
    rows = rows_of(df)
    want = sorted(((r[0], *m) for r, m in zip(rows, brute.mix(rows, key), strict=True)), key=str)
    assert [(g[0], g[1], g[2], g[4]) for g in got] == [(w[0], w[1], w[2], w[4]) for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    return got


def test_targets_and_cuts_as_by_brute_force(edges):
    check(edges)


def test_given_documents_meet_their_targets(spark, texts):
    df = spark.createDataFrame([(i, s, t) for i, t, _, s in texts], "doc_id long, source string, text string")
    got = check(df)
    assert all(g[4] <= 2 * g[1] for g in got)
    source = {i: s for i, _, _, s in texts}
    taken, target = Counter(), {}
    for doc_id, _, _, aim, words in got:
        taken[source[doc_id]] += words
        target[source[doc_id]] = aim
    assert all(target[s] - 1.001 <= taken[s] <= target[s] for s in target)


def test_a_hot_source_and_alike_rows(spark):
    rows = [(i, "hot", "a b c") for i in range(300)] + [(7, "x", "a b"), (7, "x", "a b"), (8, None, "one"), (9, "y", "")]
    check(spark.createDataFrame(rows, "doc_id long, source string, text string"))


def test_many_ranges_and_repeated_rows_on_their_edges(spark):
    rows = [(i % 90, "hot", "a b c " * (i % 5)) for i in range(900)] + [(None, "hot", "d e")] * 40
    rows += [(i, f"s{i % 7}", "a b") for i in range(50)]
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, source string, text string")
        assert mixing.ranged(mixing.sizes(df), [*mixing.SOURCE, "key"], "ranges").select("part").distinct().count() > 3
        check(df)
    finally:
        spark.conf.unset(name)


def test_as_many_sources_as_documents(spark):
    words = F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 9).cast("int")), " ")
    source = F.concat(F.lit("s"), F.col("id"))
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), source.alias("source"), words.alias("text"))
    check(docs)


def test_mixed_documents_are_whole_and_repeated(edges):
    mixed = mixing.mixed_documents(edges)
    assert mixed.columns == edges.columns
    counts = Counter((r["doc_id"], r["source"], r["text"]) for r in mixed.collect())
    rows = rows_of(edges)
    times = Counter(rows)
    for row, (size, _, _, taken) in zip(rows, brute.mix(rows, key), strict=True):
        if size:
            assert counts[row] == times[row] * int(taken / size + 0.5)


def test_empty_table_and_no_words(spark, nothing):
    assert mixing.mix(nothing).count() == mixing.mixed_documents(nothing).count() == 0
    blank = spark.createDataFrame([(1, "a", " "), (2, None, None)], "doc_id long, source string, text string")
    assert sorted(tuple(r) for r in mixing.mix(blank).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
