"""Boosting against a plain version that looks at every row and cut."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlog.operators import boosting


def rows_of(n=160, classes=3, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = int(rng.integers(1, classes + 1)) if i % 11 else 0
        x = [float(rng.integers(0, 12)) + 3 * (y == 1), float(rng.standard_normal() + 2 * (y == 2)), float(rng.integers(0, 3)), 1.0]
        out.append((x, y, i % 4 == 0))
    return out


def plain(rows, classes, rounds, depth, rate, cuts):
    """The same booster by loops over rows, features and cuts."""
    data = [(x, y, v) for x, y, v in rows if y > 0]
    train = [(x, y) for x, y, v in data if not v]
    counts = {c: sum(y == c for _, y in train) for _, c in train}
    weight = {c: len(train) / (len(counts) * n) for c, n in counts.items()}
    margins = [[0.0] * classes for _ in data]
    losses, trees_of = [], []
    for _ in range(rounds):
        probs = [[math.exp(m) / sum(map(math.exp, row)) for m in row] for row in margins]
        trees = []
        for k in range(classes):
            g = [weight.get(y, 1.0) * (probs[i][k] - (y == k)) for i, (_, y, _) in enumerate(data)]
            h = [weight.get(y, 1.0) * 2 * probs[i][k] * (1 - probs[i][k]) for i, (_, y, _) in enumerate(data)]

            def grow(own, level, g=g, h=h):
                best = None
                for f in range(len(cuts)):
                    for c in cuts[f]:
                        sides = [[i for i in own if not data[i][2] and (data[i][0][f] <= c) == s] for s in (True, False)]
                        (gl, hl), (gr, hr) = ((sum(g[i] for i in s), sum(h[i] for i in s)) for s in sides)
                        gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1)
                        if hl >= 1 and hr >= 1 and gain > 1e-6 and (best is None or gain > best[0] * (1 + 1e-8)):
                            best = (gain, f, c, -gl / (hl + 1), -gr / (hr + 1))
                if level == 0 or best is None:
                    return None
                _, f, c, a, b = best
                left, right = ([i for i in own if (data[i][0][f] <= c) == s] for s in (True, False))
                return f, c, (grow(left, level - 1), rate * a), (grow(right, level - 1), rate * b)

            trees.append(grow(range(len(data)), depth))
        for i, (x, _, _) in enumerate(data):
            for k, tree in enumerate(trees):
                value = 0.0
                while tree is not None:
                    tree, value = tree[2] if x[tree[0]] <= tree[1] else tree[3]
                margins[i][k] += value
        trees_of.append(trees)
        val = [i for i, d in enumerate(data) if d[2]]
        losses.append(sum(math.log(sum(map(math.exp, margins[i]))) - margins[i][data[i][1]] for i in val) / len(val))
    return margins, losses


def frame(spark, rows):
    return spark.createDataFrame(rows, "x array<double>, y int, val boolean").repartition(3)


def test_equals_the_plain_version(spark):
    rows = rows_of()
    booster = boosting.fit(frame(spark, rows), 4, rounds=3, depth=3, rate=0.3, patience=9)
    margins, losses = plain(rows, 4, 3, 3, 0.3, booster.cuts)
    best = int(np.argmin(losses)) + 1
    assert len(booster.rounds) == best == 3
    x = np.array([r[0] for r in rows if r[1] > 0])
    assert np.allclose(booster.margins(booster.bins(x)), margins)
    assert losses[2] < losses[0]


def test_rounds_after_the_best_are_dropped(spark):
    rng = np.random.default_rng(1)
    noise = [([float(rng.integers(0, 6)), float(rng.integers(0, 6))], int(rng.integers(1, 3)), i % 3 == 0) for i in range(90)]
    booster = boosting.fit(frame(spark, noise), 3, rounds=12, depth=3, rate=0.9, patience=2)
    _, losses = plain(noise, 3, 12, 3, 0.9, booster.cuts)
    stop = boosting.EarlyStop(2, 0.0)
    for i, x in enumerate(losses):
        stop.better(x, i)
        if stop.over:
            break
    assert len(booster.rounds) == stop.best_round + 1 < 12


def test_probabilities_and_round_trip(spark):
    rows = rows_of()
    booster = boosting.fit(frame(spark, rows), 4, rounds=2, depth=2)
    again = boosting.Booster.of(json.loads(json.dumps(booster.as_dict())))
    nodes = spark.createDataFrame([(i, x[:2], x[2:]) for i, (x, _, _) in enumerate(rows)], "id int, a array<double>, b array<double>")
    out = {r.id: r.probs for r in boosting.with_probabilities(nodes, again, ["a", "b"]).collect()}
    want = boosting.softmax(booster.margins(booster.bins(np.array([r[0] for r in rows]))))
    assert np.allclose([out[i] for i in range(len(rows))], want)
    assert boosting.with_probabilities(nodes, None, ["a"]).select(F.first("probs")).first()[0] == [1.0]


@pytest.mark.parametrize("rows", [[], [([1.0], 1, False), ([2.0], 1, False), ([2.0], 2, True)], [([1.0], 0, False), ([2.0], 1, False)]])
def test_fewer_than_two_classes(spark, rows):
    assert boosting.fit(frame(spark, rows), 3, rounds=2) is None
