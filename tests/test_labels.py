import json

from pyspark.sql import functions as F

from modlytics import schemas
from modlytics.operators.labels import (
    cut_batches,
    hybrid_labels,
    label_payloads,
    label_rows,
    merge_labels,
    parse_label_payloads,
)


def comments(spark, *sizes):
    """Creators c0, c1, ... with so many comments; every text is harmless but for c<n>'s comment 1."""
    data = [
        (f"c{c}", 100 * c + p, p, "what a damn shame" if p == 1 else f"text {p}")
        for c, n in enumerate(sizes)
        for p in range(n)
    ]
    return spark.createDataFrame(data, "profile_url STRING, comment_id BIGINT, pos BIGINT, text STRING")


def landed(spark, answers):
    data = [(url, batch, a if a is None or isinstance(a, str) else json.dumps(a)) for (url, batch), a in answers.items()]
    return spark.createDataFrame(data, "profile_url STRING, batch_id BIGINT, payload STRING")


def test_batches(spark):
    cut = cut_batches(comments(spark, 120, 3))
    got = cut.groupBy("profile_url", "batch_id").agg(F.min("id"), F.max("id"), F.count("*")).collect()
    assert sorted(tuple(r) for r in got) == [
        ("c0", 0, 0, 49, 50), ("c0", 1, 0, 49, 50), ("c0", 2, 0, 19, 20), ("c1", 0, 0, 2, 3),
    ]


def test_payloads(spark):
    sent = label_payloads(cut_batches(comments(spark, 3), 2))
    got = {r.batch_id: (json.loads(r.payload), r["items"]) for r in sent.collect()}
    assert got == {
        0: ([{"id": 0, "text": "text 0"}, {"id": 1, "text": "what a damn shame"}], 2),
        1: ([{"id": 0, "text": "text 2"}], 1),
    }


ANSWERS = {
    "good": ([{"id": 0, "classification": "Spam", "severity_score": 0.5, "flagged_words": "x, y"}], True),
    "empty": ([], True),
    "number as text": ([{"id": 0, "severity_score": "0.8"}], True),
    "whole number": ([{"id": 0, "severity_score": 1}], True),
    "no severity": ([{"id": 0}], True),
    "null id": ([{"id": None}], True),
    "missing": (None, False),
    "empty text": ("", False),
    "not json": ("sorry, I cannot", False),
    "cut off": ('[{"id": 0', False),
    "trailing": ('[{"id": 0}] done', False),
    "object": ({"id": 0}, False),
    "no id": ([{"id": 0}, {"classification": "Spam"}], False),
    "no object": ([1], False),
    "word as severity": ([{"id": 0, "severity_score": "high"}], False),
    "null severity": ([{"id": 0, "severity_score": None}], False),
}


def test_which_answers_are_ok(spark):
    parsed = parse_label_payloads(landed(spark, {(name, 0): a for name, (a, _) in ANSWERS.items()}))
    assert {r.profile_url: r.ok for r in parsed.collect()} == {name: ok for name, (_, ok) in ANSWERS.items()}
    rows = {r.profile_url: r for r in label_rows(parsed).collect()}
    assert set(rows) == {"good", "number as text", "whole number", "no severity", "null id"}
    assert rows["number as text"].severity_score == 0.8 and rows["whole number"].severity_score == 1.0


def test_merge_takes_the_last_of_an_id_and_defaults(spark):
    labels = spark.createDataFrame(
        [
            ("c0", 0, 1, 0, "Spam", 0.5, "a"),
            ("c0", 0, 1, 7, "Odd", 0.7, None),
            ("c0", 0, 1, 3, "Toxic", 0.6, "b"),
            ("c0", 1, 0, 0, None, None, "c"),
            ("c0", 0, 9, 1, "Spam", 0.9, "no such comment"),
            ("c0", 0, None, 2, "Spam", 0.9, "no id"),
        ],
        schemas.EXTERNAL_LABEL,
    )
    merged = merge_labels(cut_batches(comments(spark, 4), 2), labels)
    got = {r.pos: (r.classification, r.severity_score, r.flagged_words) for r in merged.collect()}
    assert got == {0: ("Proper", 0.0, ""), 1: ("Odd", 0.7, ""), 2: ("Proper", 0.0, "c"), 3: ("Proper", 0.0, "")}


def test_hybrid(spark):
    batched = cut_batches(comments(spark, 4, 4, 4, 2), 2)
    odd = {"classification": "Odd", "severity_score": 0.4, "flagged_words": "w, v"}
    answers = landed(
        spark,
        {
            # c0: all batches well; of two items for an id the last counts, an id in quotes names nothing.
            ("c0", 0): [{"id": 0, "classification": "Spam"}, {"id": 0, **odd}, {"id": "1", **odd}],
            ("c0", 1): [{"id": 1, "severity_score": 0.2}],
            # c1: one batch broken, the other's labels are dropped too.
            ("c1", 0): [{"id": 0, **odd}],
            ("c1", 1): "[",
            # c2: one batch never came back. c3: none did.
            ("c2", 0): [{"id": 0, **odd}],
        },
    )
    got = {
        (r.profile_url, r.pos): (r.scan_ok, r.classification, r.severity_score, r.flagged_words, r.triggers)
        for r in hybrid_labels(batched, parse_label_payloads(answers)).collect()
    }
    proper = ("Proper", 0.0, "", [])
    by_rules = {0: proper, 1: ("Toxic", 0.43, "damn", ["damn"]), 2: proper, 3: proper}
    expected = {("c0", p): (True, *proper) for p in range(4)}
    expected["c0", 0] = (True, "Odd", 0.4, "w, v", ["w", "v"])
    expected["c0", 3] = (True, "Proper", 0.2, "", [])
    for creator, n in (("c1", 4), ("c2", 4), ("c3", 2)):
        expected.update({(creator, p): (False, *by_rules[p]) for p in range(n)})
    assert got == expected
