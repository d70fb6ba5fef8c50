import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from modlytics.llm import licenses, pii, quality, toxicity

ANCHORS = pii.automaton()


# --- quality ---


def test_base_counts_as_by_brute_force(edges, texts):
    for text in [t for _, t, _, _ in texts] + [r["text"] for r in edges.collect()] + ["a " * 40, "x\n\nx\n x \nx", "a b c d e f g h a b c d e f g h i"]:
        words = (text or "").encode().split()
        counts = quality.base_counts(text or "", words)
        assert (len(words), *counts, quality.base_failed(len(words), counts[3])) == brute.quality(text)


def test_distance_is_zero_to_itself_and_one_to_the_opposite():
    assert quality.distance(np.array([0.5, 0.5, 0]), np.array([0.5, 0.5, 0])) == 0
    assert quality.distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)


def test_verdicts_over_a_table_and_as_a_filter(spark, edges, small):
    for df in (edges, spark.read.parquet(f"{small}/documents.parquet")):
        known, made = quality.references(df), quality.Histograms()
        rows = df.select("doc_id", "text", "lang").collect()
        want = sorted(((r["doc_id"], *quality.verdict(made, known, r["text"] or "", r["lang"])) for r in rows), key=str)
        assert sorted((tuple(r) for r in quality.judged(df).collect()), key=str) == want
        kept = quality.keep_good(df)
        assert kept.columns == df.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if w[-1])


def test_short_texts_have_no_distance():
    made = quality.Histograms()
    known = {("en", "chars"): np.ones(16) / 16, ("en", "words"): np.ones(31) / 31}
    short = quality.verdict(made, known, "one two three " * 3, "en")
    assert short[6] is None and short[7] is None
    assert quality.verdict(made, known, "abc " * 60, "tlh")[7] is None


def test_labelled_junk_goes_and_labelled_good_stays(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    judged = quality.judged(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id")
    found = {(r["quality"], r["kept"]): r["count"] for r in judged.filter("not base_failed").groupBy("quality", "kept").count().collect()}
    assert found.get((1, False), 0) <= 0.01 * found[1, True]
    assert found[0, False] >= 5 * found.get((0, True), 0)


def test_words_of_short_texts_count():
    """Junk of 50 to 79 words whose characters are as usual."""
    made = quality.Histograms()
    usual = " ".join(["of the house and to a man in that is for it as was with be", "lamp tree road city boat hill"] * 40)
    known = {("en", "chars"): made.chars(usual), ("en", "words"): made.words(usual.encode().split(), "en")}
    for n in (25, 60):
        junk = " ".join(("lamp tree road city boat hill mast".split() * 9)[:n])
        assert quality.verdict(made, known, " ".join(usual.split()[:n]), "en")[7] < quality.words_limit(n)
        assert quality.verdict(made, known, junk, "en")[7] > quality.words_limit(n)
    assert quality.words_limit(20) > quality.words_limit(80) > quality.words_limit(800) > quality.WORDS_AWAY


def test_clean_texts_of_unlisted_languages_stay(spark):
    """Two languages of different scripts, half and half, and junk in one of them."""
    chance = random.Random(3)

    def text(letters):
        return " ".join("".join(chance.choice(letters) for _ in range(chance.randint(2, 8))) for _ in range(120)) + "."

    rows = [(i, text("aeioulmnrst"), "it") for i in range(60)] + [(100 + i, text("的一是不了人我在有他这"), "zh") for i in range(60)]
    rows += [(200, "".join(chance.choice("#$%0123456789 ") for _ in range(900)), "it")]
    rows += [(300, text("अआइकखग"), "hi"), (301, text("αβγδε"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    want = {r[0] for r in rows} - {200}
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == want
    assert {r["doc_id"] for r in quality.judged(df).filter("kept").collect()} == want
    assert {lang for lang, _ in quality.references(df)} == {"it", "zh"}


# --- personal data ---


def test_base_spans_of_random_texts_as_by_regular_expression():
    chance = random.Random(5)
    parts = ["1", "0", "4", "12", "255", "256", ".", ".", "-", " ", "@", "+", "+1", "a", "b.c", "%", "(", ")", "é", "x@y.z"]
    parts += ["4111 1111 1111 1111", "1.2.3.4", "555-123-4567", "\n", "://", "IBAN "]
    for _ in range(20_000):
        text = "".join(chance.choice(parts) for _ in range(chance.randint(0, 30)))
        assert [s for s in pii.spans_of(text, ANCHORS) if s[0] in pii.BASE_KINDS] == brute.private(text), text


def test_own_spans_are_checked():
    text = "IBAN: DE89 3704 0044 0532 0130 00, IBAN DE88370400440532013000; http://bob:pw@h.org/x http://h.org account no. 12345678 account 12"
    own = [(k, text[a:b]) for k, a, b in pii.spans_of(text, ANCHORS) if k not in pii.BASE_KINDS]
    assert own == [("login", "http://bob:pw@h.org"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]


def test_personal_data_over_a_table(edges, nothing, spark):
    got = pii.personal_data(edges).collect()
    assert len(got) == edges.count() and all(r["spans"] == [] for r in got)
    assert pii.personal_data(nothing).count() == 0
    df = spark.createDataFrame([(1, "é a@b.co, 10.0.0.1")], "doc_id long, text string")
    assert [tuple(s) for s in pii.personal_data(df).first()["spans"]] == [("email", 2, 8), ("ip", 10, 18)]


# --- licences ---

NOTICES = [
    (1, "Released under the MIT License. under the mit license, UNDER THE MIT\nLICENSE"),
    (2, "Licensed under the Apache License, Version 2.0."),
    (3, "Licensed under CC BY-NC 4.0. cc by nc-cc-by-nc"),
    (4, "This work is licensed under the GNU General Public License, version 3."),
    (5, "GNU General Public License, version 3"),
    (6, "mit the under license; under the License mit; apache license version 20; cc-by"),
    (7, "under the mİt license under the MIT éLicense"),
    (8, "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    (9, None),
    (10, ""),
]


def test_licence_places_labels_and_scores(spark):
    df = spark.createDataFrame(NOTICES, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.license_labels(df).collect()}
    assert got[1] == (13, 3, 1, 9, "mit", "mit", 1.0)
    assert got[2] == (8, 1, 3, 3, "apache-2", "apache-2", 1.0)
    assert got[3] == (13, 3, 2, 10, "cc-by-nc", "cc-by-nc", 1.0)
    assert got[4] == (12, 0, None, None, "", "gpl-3", 1.0)
    assert got[5] == (6, 0, None, None, "", "gpl-3", pytest.approx(6 / 12))
    assert got[6][1:] == (0, None, None, "", "", 0.0)
    assert got[7] == (8, 0, None, None, "", "", 0.0)
    assert got[8][4:] == ("", "bsd", 1.0)[0:1] + ("bsd", 1.0)
    assert got[9] == got[10] == (0, 0, None, None, "", "", 0.0)


def test_rare_words_follow_the_corpus(spark):
    df = spark.createDataFrame([(i, "mit license") for i in range(5)] + [(9, "under the")], "doc_id long, text string")
    counts = licenses.document_counts(df, licenses.TEMPLATES)
    assert (counts["mit"], counts["under"]) == (5, 1)
    assert [w for w, _ in licenses.rare_places(licenses.TEMPLATES[0], counts)] == ["under", "the"]


def test_licence_edges(edges, nothing):
    assert licenses.license_labels(edges).filter("labels = ''").count() == edges.count()
    assert licenses.license_labels(nothing).count() == 0


def test_licence_plan_has_no_python(edges):
    plan = licenses.license_labels(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "hashpartitioning" not in plan


# --- toxicity ---


def test_held_out_rows_beat_the_majority(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    right = np.mean([r["predicted"] == r["toxic"] for r in rows])
    assert right > np.mean([r["toxic"] == 0 for r in rows])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_held_out_rows_are_not_trained_on(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    sample = {t for t, _ in toxicity.training_texts(df, labels)}
    held = {r["text"] for r in df.filter(toxicity.held_out(F.col("doc_id"))).collect()}
    assert held and not held & sample and len(held | sample) == 500


def test_toxicity_edges(spark, edges, nothing):
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(edges, no_labels).collect()] == [0.0] * edges.count()
    labels = spark.createDataFrame([(4, 1), (5, 1), (7, 0), (8, 0), (1, None), (99, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(edges, labels).count() == edges.count()
    assert toxicity.toxicity(nothing, labels).count() == 0


def labelled_words(n, phrase, seed):
    """Texts of common words, every third toxic by a phrase of words that ordinary texts hold too."""
    rng = random.Random(seed)
    common = [f"w{a}{b}" for a in "bcdfg" for b in ("ane", "olt", "irk", "ush")] + phrase
    texts = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(60)]
        if i % 3 == 0:
            words[20:20] = phrase
        texts.append((" ".join(words), int(i % 3 == 0)))
    return texts


def test_threats_of_ordinary_words_are_found():
    phrase = "we know where you sleep".split()
    model = toxicity.fit(labelled_words(600, phrase, 1))
    savings = toxicity.Savings(model.ordinary, model.toxic)
    right = [(toxicity.score(model, savings, t) >= 0.5) == (label == 1) for t, label in labelled_words(300, phrase, 2)]
    assert np.mean(right) > 0.97


def test_scores_as_by_brute_force(texts):
    model = toxicity.fit(labelled_words(120, "we know where you sleep".split(), 3) + [("an ordinary text", 0)])
    savings = toxicity.Savings(model.ordinary, model.toxic)
    for text in [*[t or "" for _, t, _, _ in texts[:60]], "", "we know where you sleep", "x" * 500, "one, two. three"]:
        assert toxicity.score(model, savings, text) == pytest.approx(brute.toxicity(model, text))


def test_rare_insults_are_learned_from_a_large_sample():
    """Each in 10 of 1,500 toxic rows; a word of two toxic rows or of both kinds is not."""
    ordinary = [f"plain row {i} common{i % 50}".encode().split() for i in range(4500)]
    insults = [b"zorgbag", b"wuffle", b"klimpet"]
    toxic = [row + ([insults[i % 3]] if i < 30 else [b"quibbletop"] if i < 32 else []) for i, row in enumerate(ordinary[:1500])]
    assert set(toxicity._toxic_spans(toxic, ordinary)) == set(insults)


def test_copies_of_one_toxic_text_are_counted_once():
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(3000)}".encode() for _ in range(40)] for _ in range(400)]
    assert toxicity._toxic_spans([texts[0]] * 30 + texts[1:40], texts[40:]) == []


def test_windows_overlap_and_long_words_are_cut():
    assert toxicity.words_of("a, " + "b" * 100) == [b"a", b"b" * 48, b"b" * 48, b"b" * 4]
    assert toxicity.windows(toxicity.words_of("")) == toxicity.windows(toxicity.words_of(" \n")) == []
    for n in range(1, 40):
        words = [b"%d" % i for i in range(n)]
        found = [w.split() for w in toxicity.windows(words)]
        assert found[-1][-1] == words[-1] and all(len(w) <= toxicity.WINDOW_WORDS for w in found)
        for i in range(max(1, n - 4)):
            assert any(words[i : i + 5] == w[k : k + 5] for w in found for k in range(len(w)))


@pytest.mark.parametrize("alphabet", [2, 4, 26])
def test_toxicity_windows_that_are_not_compressed_save_nothing(alphabet):
    chance = random.Random(alphabet)
    letters = [bytes([97 + i]) for i in range(alphabet)]

    def run(words):
        return b" ".join(b"".join(chance.choices(letters, k=chance.randint(1, 9))) for _ in range(words))

    ordinary, toxic = run(2500), run(60)
    savings = toxicity.Savings(ordinary, toxic)
    assert savings.machine is not None
    both, skipped = toxic + ordinary, 0
    for _ in range(2000):
        at = chance.randrange(len(both) - 60)
        near = chance.randrange(len(toxic) - 30, len(toxic))  # over the seam
        window = b" ".join([run(chance.randint(0, 3)), both[at : at + chance.randint(3, 60)], both[near : near + 30][: chance.randint(0, 40)]])
        framed = b" " + window + savings.carrier
        if not savings.may_save(framed):
            skipped += 1
            assert len(savings.plain.compress(framed)) == len(savings.both.compress(framed))
    assert skipped
    # Too small a dictionary for that, or none: every window is compressed.
    assert toxicity.telling(ordinary[:1000], toxic) == toxicity.telling(ordinary, b"") == set()
