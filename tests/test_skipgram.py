import numpy as np
import pytest

from weftlog.operators import skipgram


def test_alias_table_gives_the_weights_back():
    weights = np.array([1.0, 5.0, 0.5, 3.5, 10.0])
    threshold, other = skipgram.alias_table(weights)
    share = threshold.copy()
    np.add.at(share, other, 1 - threshold)
    assert np.allclose(share / len(weights), weights / weights.sum())


def test_pairs_lie_within_the_window():
    ids = np.arange(10)
    centre, context = skipgram.pairs(ids, 3, np.random.default_rng(1))
    assert len(centre) and (np.abs(centre - context) <= 3).all() and (centre != context).all()
    assert {(a, b) for a, b in zip(centre, context, strict=True) if abs(a - b) == 1} == {(a, b) for a in ids for b in ids if abs(a - b) == 1}


def test_a_step_follows_the_gradient():
    rng = np.random.default_rng(2)
    inner, outer = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))

    def loss(a, b):
        sig = lambda x: 1 / (1 + np.exp(-x))
        return -np.log(sig(a[0] @ b[1])) - np.log(sig(-a[0] @ b[2])) - np.log(sig(-a[0] @ b[3]))

    a, b = inner.copy(), outer.copy()
    skipgram.learn(a, b, np.array([0]), np.array([1]), np.array([[2, 3, 1]]), 1e-6)
    for matrix, moved in ((0, a), (1, b)):
        for i in range(4):
            for j in range(3):
                up = [inner.copy(), outer.copy()]
                up[matrix][i, j] += 1e-6
                slope = (loss(*up) - loss(inner, outer)) / 1e-6
                assert abs((moved - (inner, outer)[matrix])[i, j] / 1e-6 + slope) < 1e-4


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        group = "ab"[i % 2]
        rest = [f"{group}:ctx{x}" for x in rng.integers(0, 4, 6)]
        rest[3] = f"{group}:syn{rng.integers(0, 2)}"
        rows.append(("r", 0, f"e{i}", rest))
    return spark.createDataFrame(rows, "run_id string, w_idx long, entity_id string, sentence array<string>")


def test_synonyms_are_neighbours_and_seeds_reproduce(corpus, monkeypatch):
    monkeypatch.setattr(skipgram, "SENTENCES", 250)
    first = {r["token"]: np.array(r["vector"]) for r in skipgram.train(corpus, size=8, window=3, epochs=6, rate=0.1).collect()}
    again = {r["token"]: np.array(r["vector"]) for r in skipgram.train(corpus, size=8, window=3, epochs=6, rate=0.1).collect()}
    assert first.keys() == again.keys() and all(np.allclose(first[t], again[t], atol=1e-9) for t in first)
    cosine = lambda x, y: first[x] @ first[y] / np.linalg.norm(first[x]) / np.linalg.norm(first[y])
    for group, foreign in ("ab", "ba"):
        assert cosine(f"{group}:syn0", f"{group}:syn1") > max(cosine(f"{group}:syn0", t) for t in first if t.startswith(foreign))


def test_too_many_tokens_and_none(spark, corpus, monkeypatch):
    assert skipgram.train(corpus.where("entity_id = ''")).count() == 0
    monkeypatch.setattr(skipgram, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="exceed"):
        skipgram.train(corpus, size=8)


def test_pairs_of_several_sentences_stay_in_their_own():
    ids, starts = np.arange(9), np.array([0, 3, 3, 4])
    centre, context = skipgram.pairs(ids, 4, np.random.default_rng(2), starts)
    part = lambda x: np.searchsorted(starts, x, "right")
    assert len(centre) and (part(centre) == part(context)).all() and (centre != context).all() and (np.diff(part(centre)) >= 0).all()
