import random
from collections import Counter
from itertools import permutations

import brute
import numpy as np
from pyspark.sql import functions as F

from modlytics.llm import audit

LABELS = "doc_id long, quality int, toxic int, text string"


def plain_counts(text):
    import re

    words = re.findall(brute.WORD, text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text))


def plain_fails(rows):
    """The filters that each (doc_id, text) fails, as a string."""
    least = {}
    for doc_id, text in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text in rows:
        words, distinct, capitals, points, symbols = plain_counts(text or "")
        failed = [words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * points, symbols > 0]
        failed.append(doc_id is not None and least[text or ""] < doc_id)
        out.append("".join(f for f, yes in zip("ABCDE", failed, strict=True) if yes))
    return out


def plain_audit(rows, labels):
    """rows of (doc_id, text, lang)."""
    good = {i for i, q, _, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t, _ in labels if i is not None and t == 1}
    fails = plain_fails([r[:2] for r in rows])
    out, shapley = {}, Counter()
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in own if d not in left]
                here = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[part, x] += len(here)
                redundant = sum(x in f and any(y in f for y in order[: step - 1]) for _, f in own)
                unique = sum(f == x for _, f in own)
                lost = [sum(i in marked for i, _ in here) for marked in (good, toxic)]
                out[part, order, step] = (len(left), len(here), redundant, unique, *lost)
                assert gone is not None
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def random_texts(n, seed):
    chance = random.Random(seed)
    alphabet = ["a", "b", "A", "Z", " ", " ", "\n", "\t", "\x0b", "\x1f", "\x00", "é", "ß", "中", "😀", " ", "#", "|", "x" * 9, "y" * 70, "y" * 69 + "z"]
    return ["".join(chance.choice(alphabet) for _ in range(chance.randrange(60))) for _ in range(n)]


def test_counts_as_by_regular_expressions(texts, edges):
    for some in ([t[1] for t in texts], [r["text"] or "" for r in edges.collect()], random_texts(3000, 5)):
        found = audit.counts([t.encode() for t in some])
        assert list(zip(*(c.tolist() for c in found), strict=True)) == [plain_counts(t) for t in some]


def test_colliding_hashes_merge_no_words(monkeypatch):
    monkeypatch.setattr(audit, "_mixed", lambda x: x * np.uint64(0))
    monkeypatch.setattr(audit.xxhash, "xxh3_64_intdigest", lambda *_: 0)
    some = random_texts(60, 6)
    assert audit.counts([t.encode() for t in some])[1].tolist() == [plain_counts(t)[1] for t in some]


def test_slices_keep_texts_whole(monkeypatch):
    monkeypatch.setattr(audit, "SLICE", 10)
    some = [b"a" * 3, b"b" * 30, b"", b"c" * 8, b"d"]
    cuts = list(audit._slices(some))
    assert cuts[0][0] == 0 and cuts[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))


def audited(docs, labels):
    return sorted(tuple(r) for r in audit.audit(audit.with_labels(audit.failures(docs), labels)).collect())


def test_audit_as_by_brute_force(spark, edges, nothing):
    marks = [(4, 1, 0, "x"), (4, 0, 1, "x"), (7, 1, None, "x"), (8, None, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")]
    labels = spark.createDataFrame(marks, LABELS)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in edges.collect()]
    assert audited(edges, labels) == plain_audit(rows, marks)
    assert audited(edges, labels.limit(0)) == plain_audit(rows, [])
    assert audited(nothing, labels) == []


def test_a_large_group_of_copies(spark):
    """A third of the rows have one text, in two languages, and ids that are spread over all partitions."""
    df = spark.range(900).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 1, "one | text").otherwise(F.concat(F.lit("Text "), F.col("id"))).alias("text"),
        F.when(F.col("id") % 2 == 0, "en").alias("lang"),
    )
    rows = [tuple(r) for r in df.collect()]
    failed = audit.failures(df.repartition(9)).collect()
    names = lambda bits: "".join(f for i, f in enumerate("ABCDE") if bits >> i & 1)
    want = {r[0]: f for r, f in zip(rows, plain_fails([r[:2] for r in rows]), strict=True)}
    assert {r["doc_id"]: names(r["fails"]) for r in failed} == want
    assert sum("E" in f for f in want.values()) == 299
