import random

import pytest
from pyspark.sql import functions as F

from modlytics.functions import automaton
from modlytics.functions.rules import deciding_hits, term_hits
from modlytics.functions.text import highlight
from modlytics.operators.moderation import LABEL_COLUMNS, moderate


def texts(seed, n):
    """Texts of terms of the lists, parts of them, capitals, links and emoji, run together."""
    chance = random.Random(seed)
    words = [t for _, terms in automaton.TIERS for t in terms]
    more = ["crap", "CRAP", "Fuck", " ", "motherfucker", "ﬁne", "www.a.com", "\U0001f600" * 5, "İ", "ı", "ß", "K", "é", "die", "dİe", "kill yourself", "x"]
    made = ["".join(chance.choice([chance.choice(words), chance.choice(more)]) for _ in range(chance.randrange(9))) for _ in range(n)]
    return [*made, "", None, "DIE " * 40, "suicide" * 3]


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts(4, 400))], "doc_id long, text string").repartition(4)


@pytest.fixture(scope="module")
def rules(spark):
    return automaton.load_version(automaton.rule_terms(spark), automaton.RULES)


def test_hits_are_those_of_the_search(some, rules):
    places = automaton.term_places(rules)(F.lower("text"))
    both = [automaton.hits_of_tier(F.col("places"), tier).alias(f"new{tier}") for tier in range(4)]
    both += [term_hits(F.lower("text"), terms).alias(f"old{tier}") for tier, (_, terms) in enumerate(automaton.TIERS)]
    rows = some.withColumn("places", places).select("text", "places", *both).collect()
    for r in rows:
        assert [r[f"new{t}"] for t in range(4)] == [r[f"old{t}"] for t in range(4)]
        low = (r.text or "").lower()
        for hit in r.places:
            assert hit.starts == [i for i in range(len(low)) if low.startswith(hit.term, i)]
    assert any(r.new2.count("crap") == 2 for r in rows)


def test_moderation_by_the_rules_version_is_moderation(some, rules):
    columns = ["doc_id", *LABEL_COLUMNS]
    assert sorted(map(str, moderate(some, version=rules).select(*columns).collect())) == sorted(map(str, moderate(some).select(*columns).collect()))
    one, other = deciding_hits(F.lower("text")), automaton.deciding_hits(rules)(F.lower("text"))
    filled = some.fillna("")
    assert filled.select("doc_id", other.alias("x")).exceptAll(filled.select("doc_id", one.alias("x"))).count() == 0


def test_marks_by_places_are_those_one_after_another(spark, some, rules):
    shown = moderate(some).select("text", "flagged_words")
    more = [("uuv xuv UVU.u", "uv, uvu, u, uv"), ("abcd bcda", "abc, bcd, da"), ("xx", ""), ("xx", None), (None, "x"), ("a+b (c)", "a+b, (c), +"), ("day damn", "URL_LINK, damn, YELLING"), ("aaaa", "aa, aaa")]
    shown = shown.unionByName(spark.createDataFrame(more, "text string, flagged_words string"))
    pairs = shown.select("text", "flagged_words", automaton.highlight_places(rules)(F.col("text"), F.col("flagged_words")).alias("new"), highlight(F.col("text"), F.col("flagged_words")).alias("old"))
    for r in pairs.collect():
        assert r.new == r.old, (r.text, r.flagged_words)


def test_versions_of_ones_own(spark, rows):
    table = automaton.rule_terms(spark).unionByName(
        spark.createDataFrame([("mine", 0, "Harmful", 0, "Zebra"), ("mine", 1, "Abusive", 0, "bra"), ("mine", 1, "Abusive", 1, ""), ("mine", 3, "Spam", 0, "ze")], automaton.TERM_LIST)
    )
    mine = automaton.load_version(table, "mine")
    texts = spark.createDataFrame([("a ZEBRA",), ("bra",), ("damn ze",), ("see www.x.com",), ("damn",)], "text string")
    assert rows(moderate(texts, version=mine), "text", "classification", "flagged_words") == [
        ("a ZEBRA", "Harmful", "zebra"), ("bra", "Abusive", "bra"), ("damn", "Proper", ""), ("damn ze", "Spam", "ze"), ("see www.x.com", "Spam", "URL_LINK"),
    ]
    nothing = automaton.load_version(table, "none")
    assert rows(moderate(texts, version=nothing).filter("classification <> 'Proper'"), "text") == [("see www.x.com",)]
    assert texts.select(F.size(automaton.term_places(nothing)(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0] == 0

