from pyspark.sql import functions as F

from modlytics.functions.scores import chart_order, safety_band, safety_score, safety_text, scan_band, severity_percent


def test_score_equals_a_correctly_rounded_decimal(spark):
    pairs = spark.range(1, 501).select(
        F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.col("id"))).alias("p")
    )
    scored = pairs.select("p", "t", safety_score(F.col("p"), F.col("t")).alias("s")).toPandas()
    wrong = [(p, t, s) for p, t, s in scored.itertuples(index=False) if s != round((p / t) * 100.0, 1)]
    assert wrong == []
    assert len(scored) == 500 * 503 // 2


def test_score_goldens(spark):
    cases = [(1, 16, 6.2), (3, 16, 18.8), (1, 3, 33.3), (2, 3, 66.7), (0, 5, 0.0), (5, 5, 100.0), (0, 0, 100.0)]
    df = spark.createDataFrame(cases, "p BIGINT, t BIGINT, e DOUBLE")
    assert df.filter(safety_score(F.col("p"), F.col("t")) != F.col("e")).count() == 0


def test_bands(spark):
    df = spark.createDataFrame(
        [(100.0,), (90.0,), (89.9,), (80.0,), (79.9,), (70.0,), (69.9,), (50.0,), (49.9,), (0.0,)], "s DOUBLE"
    )
    got = df.select("s", scan_band(F.col("s")), safety_band(F.col("s")), safety_text(F.col("s"))).collect()
    assert [r[1] for r in got] == ["green"] * 4 + ["amber"] * 4 + ["red"] * 2
    assert [r[2] for r in got] == ["green"] * 2 + ["amber"] * 4 + ["orange"] * 2 + ["red"] * 2
    assert len({r[3] for r in got}) == 4


def test_severity_percent_is_cut_off(spark):
    df = spark.createDataFrame([(0.58,), (0.66,), (0.0,), (1.0,), (0.005,)], "s DOUBLE")
    assert [r[0] for r in df.select(severity_percent(F.col("s"))).collect()] == [57, 66, None, 100, None]


def test_chart_order(spark):
    df = spark.createDataFrame([(c,) for c in ("Proper", "Spam", "Toxic", "Abusive", "Harmful", "Odd")], "c STRING")
    assert [r[0] for r in df.select(chart_order(F.col("c"))).collect()] == [0, 1, 2, 3, 4, 9]
