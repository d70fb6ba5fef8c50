import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlytics.llm import negatives, neighbours
from modlytics.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, key string, vec string, block int, score double, members int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "v", 1, 0.5, 2) for r in rows], SCHEMA).repartition(3)


def usable(rows):
    whole = [r for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = [len(r[1]) for r in whole]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d), default=0)
    return [r for r in whole if len(r[1]) == dim]


def odd_rows(n=700, dim=5, seed=3):
    """Vectors in clusters with ties, repeated rows, nulls, undefined and infinite components, and other lengths."""
    chance = np.random.default_rng(seed)
    centres = chance.standard_normal((6, dim))
    rows = []
    for i in range(n):
        v = (centres[i % 6] + chance.integers(-2, 3, dim) / 4).astype(np.float32).tolist()
        rows.append((i, v, int(chance.integers(0, 4))))
    rows += [(n + i, rows[100][1], i % 4) for i in range(n // 2)]  # a third of all rows
    rows += [(800, rows[100][1], 0), rows[200], rows[200], rows[300], rows[301]]
    bad = [None, [], [1.0], [0.0] * dim, [None, *[1.0] * (dim - 1)], [math.nan] * dim, [math.inf, *[0.0] * (dim - 1)], [1.0] * (dim + 1)]
    rows += [(5000 + 100 * i, v, 1) for i, v in enumerate(bad)]
    return [*rows, (None, rows[5][1], 1), (6000, rows[6][1], None), (6100, [-0.0, *rows[7][1][1:]], 2)]


def plain_negatives(rows):
    rows = [r for r in usable(rows) if r[2] is not None]
    made = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows]
    anchors = {}
    for i, label, v in made:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for anchor, (label, v) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i, other) for i, other, w in made if i != anchor)
        for positive, i, _ in [s for s in scored if s[2] == label][:5]:
            near = [(m, j) for m, j, other in scored if other != label and 80 * -positive <= 100 * -m <= 100 * -positive][:5]
            out += [(anchor, i, k, j, -positive, -m) for k, (m, j) in enumerate(near, 1)]
    return sorted(out)


def mined(df):
    found = negatives.hard_negatives(negatives.vectors_of(df), F.col("vec_id") % 100 == 0)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


def test_negatives_as_by_brute_force(spark, monkeypatch):
    rows = odd_rows()
    want = plain_negatives(rows)
    assert len(want) > 100 and mined(table(spark, rows)) == want
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 64)
    monkeypatch.setattr(negatives, "PAIRS", 50)
    monkeypatch.setattr(negatives, "COMPONENTS", 30)
    assert mined(table(spark, rows)) == want


def test_negatives_of_wide_vectors_and_of_nothing(spark):
    chance = np.random.default_rng(1)
    rows = [(i * 50, (chance.standard_normal(70) * 10.0 ** (i % 4 * 2)).astype(np.float32).tolist(), i % 3) for i in range(60)]
    rows.append((77, [0.0] * 70, 1))
    assert mined(table(spark, rows)) == plain_negatives(rows)
    assert mined(table(spark, rows).limit(0)) == []
    assert mined(table(spark, rows).filter("vec_id = 77")) == []


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_intervals_hold_every_score(dim):
    chance = np.random.default_rng(dim)
    rows = chance.integers(-300, 300, (500, dim))
    rows[0], rows[1] = 0, 1
    anchors = np.concatenate([rows[:40], 5 * rows[40:60]])
    low, high = negatives.Planes(anchors).intervals(*negatives.encoded(rows), slice(0, 60))
    scores = anchors @ rows.T
    assert (low <= scores).all() and (scores <= high).all()
    # Much narrower than what lengths alone say.
    lengths = np.linalg.norm(anchors, axis=1)[:, None] * np.linalg.norm(rows, axis=1)
    assert np.median((high - low)[:, 2:] / (2 * lengths[:, 2:] + 1)) < (0.7 if dim > 3 else 0.95)


def plain_nearest(rows, every, wanted=20):
    """Query -> its nearest (vec_id, score), among one row per id and without zero vectors."""
    named = {}
    for i, v, _ in usable(rows):
        v = (np.array(v, np.float32) + np.float32(0)).astype(float)
        if v.any():
            named.setdefault(i, v)
    ids, vectors = np.array(list(named)), np.stack(list(named.values()))
    out = {}
    for i in ids[ids % every == 0].tolist():
        scores = vectors @ named[i]
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != i][:wanted]
        out[i] = [(int(ids[k]), float(scores[k])) for k in order]
    return out


def searched(df, every):
    found = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % every == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def recall(found, want):
    """The share of the true neighbours' scores that is reached, place by place, so that ties don't matter."""
    assert set(found) == set(want)
    hits = total = 0
    for query, true in want.items():
        assert len(found[query]) == len(true) and query not in dict(found[query])
        assert [x for x, _ in found[query]] == [x for x, _ in sorted(found[query], key=lambda p: (-round(p[1], 9), p[0]))]
        hits += sum(a[1] >= b[1] - 1e-9 for a, b in zip(found[query], true, strict=True))
        total += len(true)
    return hits / total


def test_neighbours_of_odd_rows(spark, monkeypatch):
    rows = odd_rows()
    want = plain_nearest(rows, 20)
    assert recall(searched(table(spark, rows), 20), want) > 0.95
    # Several cells, several blocks a cell, several leaves a block.
    for name, value in (("CELL_ROWS", 40), ("BLOCK_ROWS", 16), ("LEAF", 4)):
        monkeypatch.setattr(neighbours, name, value)
    found = searched(table(spark, rows), 20)
    assert recall(found, want) > 0.9
    # Equal vectors: the smaller ids, exactly.
    assert [x for x, _ in found[700]][:3] == [x for x, _ in want[700]][:3]


def test_neighbours_that_are_few_or_none(spark):
    rows = [(20 * i, [1.0, float(i)], 0) for i in range(6)] + [(7, [0.0, 0.0], 0)]
    assert searched(table(spark, rows), 20) == plain_nearest(rows, 20)
    assert searched(table(spark, rows).limit(0), 20) == {}
    assert searched(table(spark, rows).filter("vec_id = 7"), 1) == {}
    doubles = table(spark, rows).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    assert searched(doubles, 20) == plain_nearest(rows, 20)


def test_recall_on_the_given_vectors(spark):
    """The given vectors lie evenly, where neighbours are hardest to find."""
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = {}
    for r in QUERIES["op13_neighbours"](spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain_nearest(rows, 20)
    shares = [len(found[q] & {x for x, _ in true}) / 20 for q, true in want.items()]
    assert np.mean(shares) >= 0.95


def test_chi_square():
    assert abs(neighbours.chi_square(18.307, 10) - 0.95) < 1e-4
    assert abs(neighbours.chi_square_quantile(0.95, 16) - 26.296) < 1e-2


def test_a_query_visits_few_cells_where_vectors_lie_in_clusters():
    chance = np.random.default_rng(0)
    centres = chance.standard_normal((64, 32)) * 10
    vectors = np.repeat(centres, 100, axis=0) + chance.standard_normal((6400, 32)) * 0.05
    longest = float(np.linalg.norm(vectors, axis=1).max())
    cells = neighbours.Cells(neighbours.projections(vectors, longest), 64)
    visited = []
    for query in vectors[::400]:
        scores = vectors @ query
        squared = query @ query + longest**2 - 2 * np.sort(scores)[-21]
        point = neighbours.projections(query[None])[0]
        visited.append((cells.squared_distances(point) <= neighbours.STOP * squared).sum())
    assert np.mean(visited) < 64
