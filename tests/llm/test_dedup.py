import random

import brute
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modlytics.llm import exact, simhash
from modlytics.llm.components import components


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=str)


def test_exact_groups_as_by_brute_force(spark, edges, texts):
    for df in (edges, spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")):
        got = [tuple(r) for r in exact.exact_groups(df).collect()]
        want = [(i, keep, n, stays, name) for i, keep, n, name, stays in brute.exact(pairs(df))]
        assert ordered(got) == ordered(want)


def test_of_repeated_rows_one_stays_with_all_columns(edges):
    left = exact.drop_exact_copies(edges)
    assert left.columns == edges.columns
    stay = [r[0] for r in brute.exact(pairs(edges)) if r[4]]
    assert ordered(r["doc_id"] for r in left.collect()) == ordered(stay)


def test_summaries_never_miss_a_frequent_digest(monkeypatch):
    monkeypatch.setattr(exact, "COUNTERS", 8)
    chance = random.Random(3)
    keys = [b"hot"] * 300 + [b"warm"] * 120 + [str(chance.randrange(400)).encode() for _ in range(600)]
    chance.shuffle(keys)
    batches = [pd.DataFrame({"digest": keys[i : i + 100]}) for i in range(0, len(keys), 100)]
    (found,) = exact._summarise(iter(batches))
    head, rest = found.iloc[0], dict(zip(found["digest"][1:], found["n"][1:], strict=True))
    assert head["n"] == len(keys) and len(rest) <= 8 and head["lost"] <= len(keys) / 9
    for key in (b"hot", b"warm"):
        assert rest[key] <= keys.count(key) <= rest[key] + head["lost"]


def test_heavy_digests_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(exact, "HEAVY_ONE_IN", 4)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    signed = exact.signatures(df.repartition(7))
    heavy = exact.heavy_digests(signed).collect()
    assert [r["group_size"] for r in heavy] == [134]
    assert ordered(tuple(r) for r in exact.exact_groups(df).collect()) == ordered(
        (i, k, n, s, h) for i, k, n, h, s in brute.exact(pairs(df))
    )


def test_fingerprints_and_components_as_by_brute_force(spark, edges, texts):
    for df in (edges, spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")):
        got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(df).collect()]
        assert ordered(got) == ordered(brute.near(pairs(df)))


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = " ".join(map(str, range(3000)))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 64)
    assert simhash.fingerprint(text) == whole == brute.fingerprint(text).to_bytes(8, "big")


@pytest.mark.parametrize("bucket", [2, 4096])
def test_no_link_is_lost_in_small_or_large_buckets(spark, bucket):
    """Chains and crowds of close fingerprints; with small buckets nearly all go by points."""
    chance = random.Random(bucket)
    prints = {chance.getrandbits(64) for _ in range(40)}
    for _ in range(6):
        at = chance.getrandbits(64)
        for _ in range(12):
            prints.add(at ^ (1 << chance.randrange(64)))
            for bit in chance.sample(range(64), chance.choice([1, 2, 3, 4, 5])):
                at ^= 1 << bit
            prints.add(at)
    prints = sorted(prints)
    close = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 4]
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df, bucket).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    assert brute.components(prints, found) == brute.components(prints, close)


def test_components_of_chains_stars_and_random_links(spark):
    chance = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 8), (8, 7)]
    links += [(chance.randrange(300, 400), chance.randrange(300, 400)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [p for p in links if p[0] != p[1]]
    want = brute.components({n for p in links for n in p}, links)
    assert set(got) == set(want)
    assert {(got[a], got[b]) for a, b in links if got[a] != got[b]} == set()
    assert len(set(got.values())) == len(set(want.values()))


def test_one_document_of_each_component_stays(edges):
    left = simhash.drop_near_copies(edges)
    assert left.columns == edges.columns
    kept = {c for _, _, c in brute.near(pairs(edges))}
    assert ordered(r["doc_id"] for r in left.collect()) == ordered(i for i, _ in pairs(edges) if i in kept)


def test_empty_tables(nothing):
    assert exact.exact_groups(nothing).count() == exact.drop_exact_copies(nothing).count() == 0
    assert simhash.near_groups(nothing).count() == simhash.drop_near_copies(nothing).count() == 0
