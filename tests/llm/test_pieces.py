from collections import Counter, defaultdict

import numpy as np
import pytest

from modlytics.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as file:
        return pieces.Vocabulary(file.read())


def enumerated(vocabulary, text):
    """Every segmentation with its log probability."""
    whole = " " + text
    spelled = {s.decode(): i for i, s in enumerate(vocabulary.surface) if s and i not in set(vocabulary.byte_ids.tolist())}
    found = {}

    def go(at, ids, weight):
        if at == len(whole):
            found[tuple(ids)] = weight
            return
        for n in range(1, 17):
            i = spelled.get(whole[at : at + n])
            if i is not None and at + n <= len(whole):
                go(at + n, [*ids, i], weight + vocabulary.logs[i])
        if whole[at] not in spelled:
            own = vocabulary.byte_ids[list(whole[at].encode())].tolist()
            go(at + 1, [*ids, *own], weight + vocabulary.logs[own].sum())

    go(0, [], 0.0)
    total = np.logaddexp.reduce(list(found.values()))
    return {ids: w - total for ids, w in found.items()}


@pytest.mark.parametrize("text", ["the cat", "ab\nc", "a▁b é", "  x", "tion\n\n"])
def test_samples_follow_the_distribution_without_replacement(vocabulary, text):
    exact, n = enumerated(vocabulary, text), 4000
    rows = defaultdict(list)
    for i, _, ids, *numbers in pieces.Sampler(vocabulary, 3).sample([text] * n, pieces.row_keys(list(range(n)), 1)):
        rows[i].append((tuple(ids.tolist()), *numbers))
        assert vocabulary.decode(ids).decode() == text
    first, weighted = Counter(), Counter()
    for sampled in rows.values():
        assert len({s[0] for s in sampled}) == len(sampled) == min(3, len(exact))
        assert [s[2] for s in sampled] == sorted((s[2] for s in sampled), reverse=True)
        first[sampled[0][0]] += 1
        for ids, log_prob, _, log_inclusion in sampled:
            assert log_prob == pytest.approx(exact[ids], abs=1e-5)
            weighted[ids] += np.exp(log_prob - log_inclusion)
    for ids, w in exact.items():
        error = 4 * np.sqrt(np.exp(w) / n) + 1e-3
        assert first[ids] / n == pytest.approx(np.exp(w), abs=error)
        # Weights by inclusion score are unbiased.
        assert weighted[ids] / n == pytest.approx(np.exp(w), abs=2 * error)


def test_rows_do_not_depend_on_their_neighbours(vocabulary, texts):
    sampler, some = pieces.Sampler(vocabulary, 2), [t for _, t, _, _ in texts[:20]]
    keys = pieces.row_keys(list(range(20)), 1)
    together = [(i, r, ids.tobytes(), *x) for i, r, ids, *x in sampler.sample(some, keys)]
    alone = [(i, r, ids.tobytes(), *x) for i in range(20) for _, r, ids, *x in sampler.sample(some[i : i + 1], keys[i : i + 1])]
    assert together == alone


def test_every_given_text_comes_back(spark, small, edges, nothing):
    for df in (edges, spark.read.parquet(f"{small}/documents.parquet")):
        sampled = pieces.segmentations(df, ["doc_id", "text"])
        rows = sampled.collect()
        assert all(r["decodes"] and r["n_pieces"] * 4 == len(r["ids"]) for r in rows)
        assert Counter(r["doc_id"] for r in rows if r["rank"] == 1) == Counter(r["doc_id"] for r in df.collect())
        back = pieces.decoded(sampled).collect()
        assert Counter(r["text"] for r in back) == Counter(r["text"] or "" for r in rows)
    assert pieces.segmentations(nothing, ["doc_id"]).count() == 0
    assert pieces.decoded(pieces.segmentations(nothing, ["doc_id"])).count() == 0


def test_empty_texts_have_one_segmentation(vocabulary):
    rows = list(pieces.Sampler(vocabulary, 3).sample(["", "a", ""], pieces.row_keys([1, 2, 3], 1)))
    assert [(i, r, len(ids)) for i, r, ids, *_ in rows if i != 1] == [(0, 1, 0), (2, 1, 0)]
    assert [tuple(x) for *x, in list(pieces.Sampler(vocabulary, 2).sample([""], pieces.row_keys([1], 1)))][0][:2] == (0, 1)


def test_words_used_most_stay_when_the_store_is_full(vocabulary, monkeypatch):
    texts = [" ".join(["the cat\nsat", "é▁b  on", f"w{i}x{i * i} z{i}", "the"]) for i in range(60)]
    keys = pieces.row_keys(list(range(60)), 1)

    def sampled(sampler, each=3):
        return [
            (i + j, r, ids.tobytes(), *x) for i in range(0, 60, each) for j, r, ids, *x in sampler.checked(texts[i : i + each], keys[i : i + each])
        ]

    whole = sampled(pieces.Sampler(vocabulary, 2))
    worked_out = []
    real = pieces.Lattice
    monkeypatch.setattr(pieces, "Lattice", lambda words, v: worked_out.extend(words) or real(words, v))
    for store in (0, 20, 150, 400):
        monkeypatch.setattr(pieces, "STORE", store)
        worked_out.clear()
        sampler = pieces.Sampler(vocabulary, 2)
        assert sampled(sampler) == whole
        lattices = sampler.lattices
        assert len(lattices.numbers) == lattices.starts.n == len(lattices.used) and len(worked_out) > len(lattices.numbers)
    assert worked_out.count(" the") == worked_out.count(" cat") == 1
