"""Queries against SQL, and the pipeline against a brute-force version."""

import brute
import duckdb
import pytest
from test_mixing import key

import corpus_pipeline
from modlytics.llm import pieces, quality
from modlytics.llm.queries import QUERIES
from modlytics.llm.sql import ORACLE

TABLES = ["documents", "pages", "labels", "embeddings"]


def ordered(rows):
    return sorted(rows, key=lambda row: tuple(map(str, row)))


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_as_in_sql(spark, small, name):
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    cursor = database.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    assert ordered(tuple(r[c] for c in names) for r in got.collect()) == ordered(cursor.fetchall())


def test_other_queries_return_a_row_for_each_of_their_table(spark, small):
    for name in set(QUERIES) - set(ORACLE) - {"op13_neighbours"}:
        table = "pages" if name == "op6_html" else "documents"
        rows = QUERIES[name](spark, small)
        if name == "op3_sentencepiece":
            rows = rows.filter("rank = 1")
        assert rows.count() == spark.read.parquet(f"{small}/{table}.parquet").count(), name


def test_base_columns_by_brute_force(spark, small, texts):
    import hashlib

    found = {r["doc_id"]: r for r in QUERIES["op8_pii"](spark, small).collect()}
    for doc_id, text, _, _ in texts:
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.private(text))
        assert found[doc_id]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert found[doc_id]["spans"].startswith(spans)
    judged = {r["doc_id"]: r for r in QUERIES["op9_quality"](spark, small).collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert all(tuple(judged[i][n] for n in names) == brute.quality(t) for i, t, _, _ in texts)


def test_pipeline_as_by_brute_force(spark, small, texts):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    known, made = quality.references(docs), quality.Histograms()
    rows = [r for r in texts if quality.verdict(made, known, r[1] or "", r[2])[-1]]
    rows = [r for r, e in zip(rows, brute.exact([r[:2] for r in rows]), strict=True) if e[4]]
    near = brute.near([r[:2] for r in rows])
    rows = [r for r, (doc_id, _, component) in zip(rows, near, strict=True) if doc_id == component]
    mixed = brute.mix([(r[0], r[3], r[1]) for r in rows], key)
    rows = [r for r, (size, _, _, taken) in zip(rows, mixed, strict=True) for _ in range(int(taken / size + 0.5))]
    with open(pieces.MODEL, "rb") as file:
        sampler = pieces.Sampler(pieces.Vocabulary(file.read()), pieces.SAMPLES)
    keys = pieces.row_keys([r[0] for r in rows], pieces.SEED)
    want = [(rows[i][0], rank, ids.astype("<i4").tobytes()) for i, rank, ids, *_ in sampler.sample([r[1] for r in rows], keys)]
    got = corpus_pipeline.run(spark, small)
    assert ordered((r["doc_id"], r["rank"], bytes(r["ids"])) for r in got.collect()) == ordered(want)
    assert all(r["decodes"] for r in got.select("decodes").collect())


def test_stages_take_any_table(spark, edges, nothing, small):
    for df in (edges, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, small)
            assert name == "sentencepiece" or out.columns == df.columns
            out.collect()
