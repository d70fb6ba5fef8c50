import pyarrow as pa
from pyspark.sql import functions as F

from modlytics.functions import automaton, slices
from modlytics.functions.rules import deciding_hits


def test_slices_hold_every_row_once_and_little_more_than_their_bytes():
    texts = pa.array(["x" * 40, None, "", "é" * 30, "y" * 500, "z", None])
    for most in (1, 50, 100, 10_000):
        found = slices.cuts((texts,), most)
        assert [i for start, rows in found for i in range(start, start + rows)] == list(range(len(texts)))
        for start, rows in found:
            assert sum(len((t or "").encode()) for t in texts[start : start + rows - 1].to_pylist()) < most
    assert slices.cuts((texts[:0],), 50) == [] and slices.cuts((texts, texts), 10_000) == [(0, 7)]


def test_a_batch_reaches_the_work_in_slices(spark):
    def rows_at_once(some: pa.Array, others: pa.Array) -> pa.Array:
        assert len(some) == len(others)
        return pa.array([len(some)] * len(some), pa.int32())

    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("a"), F.lit(None).cast("string").alias("b"))
    most = texts.select(slices.sliced(rows_at_once, "int")("a", "b").alias("n")).agg(F.max("n"), F.count("n")).first()
    assert most[0] <= slices.SLICE_BYTES // 2000 + 1 and most[1] == 4000


def test_searches_give_the_same_in_any_slices(spark, rows, monkeypatch):
    texts = [f"{'kill yourself ' * (i % 3)}{'x' * (i % 50)} damn www.a.com"[i % 20 :] for i in range(300)] + ["", None]
    comments = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, text STRING").coalesce(1)
    version = automaton.load_version(automaton.rule_terms(spark), automaton.RULES)

    def found():
        return rows(comments.select(
            "id", deciding_hits(F.lower("text")).alias("hits"), automaton.term_places(version)(F.lower("text")).alias("places"),
            automaton.highlight_places(version)(F.col("text"), F.lit("damn, xx")).alias("marked"),
        ))

    whole = found()
    monkeypatch.setattr(slices, "SLICE_BYTES", 100)
    assert found() == whole
