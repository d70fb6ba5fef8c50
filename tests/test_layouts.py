"""Layouts that serve one creator or one search: ordered files, the index of trigrams, packed exports."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from modlytics import schemas
from modlytics.operators import ordered, text_index, views
from modlytics.plans.fixtures import stored_tables
from modlytics.plans.reports import export_packed
from modlytics.session import scratch_path
from modlytics.sources import csv_files


def hot_comments(spark, n=6000):
    """One creator has half of all rows. Times and severities repeat and are null at times."""
    return spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 40)).alias("profile_url"),
        F.xxhash64("id").alias("comment_id"),
        F.lit("ann").alias("author"),
        F.concat(F.lit("text "), "id").alias("text"),
        F.when(F.col("id") % 50 != 0, F.concat(F.lit("2024-01-01 00:00:"), F.lpad(F.pmod(F.xxhash64("id"), F.lit(60)).cast("string"), 2, "0"))).alias("timestamp"),
        F.lit("Spam").alias("classification"),
        F.when(F.col("id") % 60 != 0, F.pmod(F.xxhash64("id"), F.lit(7)) / 10).alias("severity_score"),
        F.lit("").alias("flagged_words"),
    )


def wanted(rows, url, value):
    """Ids of a creator in order: greatest first, null last, then by id."""
    own = sorted((r for r in rows if r.profile_url == url), key=lambda r: r.comment_id)
    known = sorted((r for r in own if r[value] is not None), key=lambda r: r[value], reverse=True)
    return [(r[value], r.comment_id) for r in known + [r for r in own if r[value] is None]]


@pytest.mark.parametrize("order", ["newest", "gravest"])
def test_a_hot_creator_is_one_sequence_over_many_files(spark, order):
    path, value = scratch_path(spark, "ordered"), ordered.ORDERS[order]
    comments = hot_comments(spark)
    rows = comments.collect()
    ordered.write_ordered(comments, path, order, files=16)
    fences = ordered.fences(spark, path)
    assert fences.filter("profile_url = 'hot'").count() >= 8
    for url in ("hot", "c3"):
        got = [(r[value], r.comment_id) for r in ordered.in_order(spark, path, url).collect()]
        assert got == wanted(rows, url, value)
    numbered = ordered.numbered(spark, path).filter("profile_url = 'hot'").collect()
    assert [(r[value], r.comment_id) for r in sorted(numbered, key=lambda r: r.position)] == wanted(rows, "hot", value)
    assert sorted(r.position for r in numbered) == list(range(3000))


def test_pages_follow_one_another(spark):
    path, comments = scratch_path(spark, "ordered"), hot_comments(spark, 1200)
    rows = comments.collect()
    ordered.write_ordered(comments, path, "newest", files=12)
    for url, size in (("hot", 130), ("c5", 7)):
        want, got, after = wanted(rows, url, "timestamp"), [], None
        while True:
            page = ordered.page(spark, path, url, size, after)
            keys = [(r.timestamp, r.comment_id) for r in page.collect()]
            if not keys:
                break
            assert len({f.rsplit("/", 1)[1] for f in page.inputFiles()}) <= 5
            got, after = got + keys, keys[-1]
        assert got == want
    assert ordered.page(spark, path, "nobody", 5).count() == 0
    late = ordered.page(spark, path, "hot", 3, ("2024-01-01 00:00:30.5", 0)).collect()
    assert [r.comment_id for r in late] == [i for t, i in wanted(rows, "hot", "timestamp") if t is None or t <= "2024-01-01 00:00:30"][:3]
    empty = scratch_path(spark, "ordered")
    ordered.write_ordered(comments.limit(0), empty)
    assert ordered.in_order(spark, empty, "hot").count() == ordered.page(spark, empty, "hot", 5).count() == 0


# --- the index of trigrams ---

TEXTS = [
    "Click here for a GIVEAWAY", "plain words", "kelvin K sign", "Kelvin K ſign", "dısmİss", "straße STRASSE", "ΟΔΟΣ odos",
    "ab", "", None, "a.b.c", "tab\tand\nline", "café cafè", "x" * 3000 + "needle", "\U0001f600 giveaways \U0001f600",
]
PATTERNS = [
    "GIVE.?AWAY", "(?:click|plain) (here|words)", "k sign", "dismiss", "straße", "σ", "a\\.b", "(?:ne){1,2}dle", "words?", "tab\\sand", "(?i)CLICK", "zzz", "\\Qa.b\\E", "",
]


def test_search_by_index_is_search(spark):
    path = scratch_path(spark, "indexed")
    data = [(f"c{i % 4}", i, t, f"t{i}") for i, t in enumerate(TEXTS * 3)]
    comments = spark.createDataFrame(data, "profile_url STRING, comment_id BIGINT, text STRING, timestamp STRING")
    text_index.write_indexed(comments, path, block_rows=6)
    blocks = spark.read.parquet(f"{path}/{text_index.ROWS}").select("block").distinct().count()
    assert blocks >= 6
    narrowed = 0
    for pattern in PATTERNS:
        want = sorted(r.comment_id for r in views.search(comments, pattern).collect())
        found = text_index.search_indexed(spark, path, pattern)
        assert sorted(r.comment_id for r in found.collect()) == want, pattern
        needed = text_index.required_trigrams(pattern) if pattern else None
        narrowed += needed is not None
    assert narrowed >= 7
    assert 0 < text_index.candidate_blocks(spark, path, text_index.required_trigrams("needle")).count() <= 3
    plan = text_index.search_indexed(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [block" in plan
    assert text_index.search_indexed(spark, path, "zzz").count() == 0
    empty = scratch_path(spark, "indexed")
    text_index.write_indexed(comments.limit(0), empty)
    assert [text_index.search_indexed(spark, empty, p).count() for p in ("", "needle", "a")] == [0, 0, 0]


def test_required_trigrams():
    needed = text_index.required_trigrams
    assert needed("abcd") == [{"abc", "bcd"}]
    assert needed("ABC|xyz!") == [{"abc"}, {"xyz", "yz!"}]
    assert needed("(ab)+cde") == [{"cde"}] and needed("x(ab)+") == [{"xab"}] and needed("ab.cde") == [{"cde"}]
    for pattern in ("ab", "a.c", "abc|de", "(?=abc)", "\\1abc", "ab[cd]", "(abc)?", "ééé", "(abc", "\\p{L}abc"):
        assert needed(pattern) is None, pattern


def test_matches_hold_what_is_required():
    """Random patterns over random texts: a text that matches has all trigrams of some set."""
    chance = random.Random(8)
    parts = ["a", "b", "c", "ab", "bc", ".", "[ab]", "(a|bc)", "(?:ab|c)+", "c*", "b?", "a{2}", "^", "$", "\\b"]
    tried = 0
    for _ in range(40_000):
        pattern = "".join(chance.choice(parts) for _ in range(chance.randrange(1, 6)))
        needed = text_index.required_trigrams(pattern)
        text = "".join(chance.choice("abc ") for _ in range(chance.randrange(12)))
        if needed is not None and re.search(pattern, text):
            tried += 1
            held = {text[i : i + 3] for i in range(len(text) - 2)}
            assert any(way <= held for way in needed), (pattern, text)
    assert tried > 50


# --- packed exports ---


def test_many_creators_and_long_links_are_packed(spark):
    path = scratch_path(spark, "pack")
    long_link = "https://example.org/" + "long/" * 400
    link = F.when(F.col("id") % 10_000 == 0, F.concat(F.lit(long_link), F.col("id"))).otherwise(F.concat(F.lit("https://x.com/é \"q\",\n"), F.col("id")))
    many = spark.range(100_000).select(
        link.alias("profile_url"), "id", F.explode(F.array(F.lit("first"), F.lit('second "line"\n, too'))).alias("text")
    )
    many = many.select(
        "profile_url", F.col("id").alias("comment_id"), F.lit("ann").alias("author"), "text", F.substring("text", 1, 1).alias("timestamp"),
        F.lit("Spam").alias("classification"), F.lit(0.5).alias("severity_score"), F.lit("").alias("flagged_words"),
    )
    hot = many.limit(1).select(F.lit("hot").alias("profile_url"), F.explode(F.sequence(F.lit(0), F.lit(9999))).alias("comment_id"), *many.columns[2:])
    loose = many.limit(5).withColumn("profile_url", F.lit(None).cast("string"))
    comments = many.unionByName(hot).unionByName(loose)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "20k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        csv_files.pack_comments(comments, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    where = path.removeprefix("file:")
    files = [f for f in os.listdir(f"{where}/{csv_files.ROWS}") if f.endswith(".csv")]
    assert 10 < len(files) <= 200
    listed = csv_files.manifest(spark, path)
    assert listed.select("creator").distinct().count() == 100_001 and listed.agg(F.sum("rows")).first()[0] == 210_000
    assert listed.filter("creator = 'hot'").count() > 1
    back = csv_files.read_pack(spark, path, schemas.EXPORT)
    kept = comments.filter("profile_url is not null").select(F.col("profile_url").alias("creator"), *schemas.EXPORT_COLUMNS)
    assert back.count() == 210_000 and back.exceptAll(kept).count() == 0
    for url in (f"{long_link}20000", 'https://x.com/é "q",\n77'):
        one = csv_files.read_pack_of(spark, path, schemas.EXPORT, url)
        assert [r.text for r in one.collect()] == ['second "line"\n, too', "first"]
    assert csv_files.read_pack_of(spark, path, schemas.EXPORT, "nobody").count() == 0
    out = scratch_path(spark, "unpacked")
    chosen = spark.createDataFrame([(f"{long_link}20000",), ("hot",), ("nobody",)], "profile_url STRING")
    names = {r.creator: r["name"] for r in csv_files.unpack(spark, path, schemas.EXPORT, chosen, out).collect()}
    folder = f"{out.removeprefix('file:')}/name={names[f'{long_link}20000']}"
    (text,) = [open(f"{folder}/{f}", newline="").read() for f in os.listdir(folder) if f.endswith(".csv")]
    assert text.startswith("author,text,timestamp,classification,severity_score,flagged_words\nann,")
    assert not os.path.exists(f"{out.removeprefix('file:')}/name={names['nobody']}")


def test_packed_order_and_texts(spark, small):
    texts = ['a "q", b\nnl', " blank at the ends ", "back\\slash", "", 'ends with "', "# hash", "a\rb"]
    data = [("u", i, "ann", t, f"2024-01-0{i + 1} 00:00:00", "Spam", 0.5, "") for i, t in enumerate(texts)]
    comments = spark.createDataFrame(data, f"profile_url STRING, comment_id BIGINT, {schemas.EXPORT}").repartition(5)
    path = scratch_path(spark, "pack")
    csv_files.pack_comments(comments, path)
    assert [r.text for r in csv_files.read_pack_of(spark, path, schemas.EXPORT, "u").collect()] == texts[::-1]
    _, stored = stored_tables(spark, small)
    folder = scratch_path(spark, "pack")
    export_packed(stored, folder, term="a")
    shown = views.flagged_view(stored, term="a").select(F.col("profile_url").alias("creator"), *schemas.EXPORT_COLUMNS)
    back = csv_files.read_pack(spark, f"{folder}/comments", schemas.EXPORT)
    assert back.count() == shown.count() > 0 and back.exceptAll(shown).count() == 0
    assert csv_files.read_pack(spark, f"{folder}/blocklist", "Username STRING").count() > 0
