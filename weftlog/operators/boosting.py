"""Gradient boosting of trees over several classes, by histograms.

Features are cut at quantiles once.  A round grows one tree for each class, level by level: tasks add up the first and second derivatives
of their rows by class, node, feature and bin, Spark adds these sums, and the best cut of each feature and then of each node is chosen
in an aggregation too, so that only one row for each open node reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.operators.stats import class_weights
from weftlog.operators.training import EarlyStop
from weftlog.scratch import written

#: Bins of a feature, the penalty on leaves, the least second derivative of a child, and the least gain of a cut.
BINS, PENALTY, LEAST_CHILD, LEAST_GAIN = 32, 1.0, 1.0, 1e-6


@dataclass
class Tree:
    """Nodes in order of growth: a cut sends bins up to ``bin`` to child ``left`` and others to the next node; a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into."""
        feature, cut, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        at, rows = np.zeros(len(bins), int), np.arange(len(bins))
        while (inner := feature[at] >= 0).any():
            f = feature[at[inner]]
            at[inner] = left[at[inner]] + (bins[rows[inner], f] > cut[at[inner]])
        return at

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> None:
        self.feature[node], self.bin[node], self.left[node] = feature, cut, len(self.feature)
        for v in values:
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.value.append(v)


@dataclass
class Booster:
    """Cuts of each feature, and the trees of each round, one for each class."""

    classes: int
    cuts: list[list[float]]
    rounds: list[list[Tree]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """How many cuts of its feature each value lies above."""
        out = np.zeros(x.shape, np.uint8)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.searchsorted(cuts, x[:, f], "left")
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), self.classes))
        for trees in self.rounds:
            add(out, bins, trees)
        return out

    def as_dict(self) -> dict:
        return {"classes": self.classes, "cuts": self.cuts, "rounds": [[[t.feature, t.bin, t.left, t.value] for t in trees] for trees in self.rounds]}

    @classmethod
    def of(cls, d: dict) -> Booster:
        return cls(d["classes"], d["cuts"], [[Tree(*t) for t in trees] for trees in d["rounds"]])


def add(margins: np.ndarray, bins: np.ndarray, trees: list[Tree]) -> None:
    for k, tree in enumerate(trees):
        margins[:, k] += np.array(tree.value)[tree.nodes(bins)]


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def derivatives(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted loss by each class's margin; the second is twice the diagonal, which bounds the whole."""
    p = softmax(margins)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    return g * weight[:, None], np.maximum(2 * p * (1 - p), 1e-16) * weight[:, None]


def quantile_cuts(rows: DataFrame, bins: int = BINS) -> list[list[float]]:
    """At most ``bins`` - 1 cuts of each place of x, at its quantiles; one row for each place reaches the driver."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.percentile_approx("v", at, 10_000).alias("cuts"), F.max("v").alias("top")).collect()
    out = [[] for _ in range(max((r.i for r in found), default=-1) + 1)]
    for r in found:
        out[r.i] = sorted({float(c) for c in r.cuts if c < r.top})
    return out


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(len(column), -1)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float, float, float] | None:
    """(bin, gain to 8 digits, value left, value right) of a feature's best cut, the first of equals."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    ok = (hl >= LEAST_CHILD) & (hr >= LEAST_CHILD)
    if not ok.any():
        return None
    gain = gl**2 / (hl + PENALTY) + gr**2 / (hr + PENALTY) - g.sum() ** 2 / (h.sum() + PENALTY)
    gain = np.where(ok, gain, -np.inf)
    at = int(np.argmax(gain >= gain.max() - 1e-9 * abs(gain.max())))  # sums in another order must not choose another of equal cuts
    return (at, float(f"{gain[at]:.8g}"), float(-gl[at] / (hl[at] + PENALTY)), float(-gr[at] / (hr[at] + PENALTY))) if gain[at] > LEAST_GAIN else None


def best_cuts(rows: DataFrame, trees: list[Tree], open_: list[set[int]], bins: int = BINS) -> list:
    """The best cut of each open node: class, node, feature, bin and both children's values. ``rows`` are (bins, margins, y, weight)."""

    def sums(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, margins = _matrix(batch.column(0), np.int64), _matrix(batch.column(1), float)
            g, h = derivatives(margins, np.asarray(batch.column(2)).astype(int), np.asarray(batch.column(3)))
            for k, tree in enumerate(trees):
                at = tree.nodes(x) if open_[k] else None
                for node in open_[k]:
                    own = np.flatnonzero(at == node)
                    place = (x[own] + np.arange(x.shape[1]) * bins).ravel()
                    parts = [np.bincount(place, np.repeat(d[own, k], x.shape[1]), x.shape[1] * bins).reshape(-1, bins) for d in (g, h)]
                    both = np.concatenate(parts, axis=1)
                    total[k, node] = total[k, node] + both if (k, node) in total else both
        for (k, node), both in total.items():
            n = len(both)
            yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array([node] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(list(both), pa.list_(pa.float64()))], names=["k", "node", "feature", "sums"])

    def choose(batches):
        for batch in batches:
            out = []
            for k, node, feature, both in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (cut := _best_cut(np.array(both[:bins]), np.array(both[bins:]))) is not None:
                    out.append((k, node, feature, *cut))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["k", "node", "feature", "bin", "gain", "below", "above"])

    summed = rows.select("bins", "margins", "y", "weight").mapInArrow(sums, "k int, node int, feature int, sums array<double>")
    summed = summed.groupBy("k", "node", "feature").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    cuts = summed.mapInArrow(choose, "k long, node long, feature long, bin long, gain double, below double, above double")
    best = cuts.groupBy("k", "node").agg(F.max_by(F.struct("feature", "bin", "below", "above"), F.struct("gain", -F.col("feature"))).alias("c"))
    return best.select("k", "node", "c.*").collect()


def fit(nodes: DataFrame, classes: int, rounds: int = 300, depth: int = 6, rate: float = 0.1, patience: int = 20, bins: int = BINS) -> Booster | None:
    """Trees from nodes (x, y, val) that have a class (y above 0), weighed by class; None with fewer than two classes among training rows.

    Rows of ``val`` only judge: rounds after the best one are dropped once ``patience`` of them bring nothing.  Each round's margins are written.
    """
    labelled = nodes.where(F.col("y") > 0).select("x", F.col("y").cast("int").alias("y"), "val")
    train = labelled.where(~F.col("val"))
    weights = written(class_weights(train, "y").select("y", "weight"), "weights")
    if len(weights.take(2)) < 2:
        return None
    booster = Booster(classes, quantile_cuts(train, bins))
    rows = labelled.join(weights, "y", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))

    def prepared(batches):
        for batch in batches:
            cut = booster.bins(_matrix(batch.column(0), float)) if batch.num_rows else np.zeros((0, 0))
            zeros = np.zeros((batch.num_rows, classes))
            yield pa.RecordBatch.from_arrays([pa.array(list(cut.astype(np.int16)), pa.list_(pa.int16())), pa.array(list(zeros), pa.list_(pa.float64())), batch.column(1), batch.column(2), batch.column(3)], names=["bins", "margins", "y", "val", "weight"])

    kinds = "bins array<short>, margins array<double>, y int, val boolean, weight double"
    rows = written(rows.select("x", "y", "val", "weight").mapInArrow(prepared, kinds), "binned")
    validates, stop = not rows.where("val").isEmpty(), EarlyStop(patience, 0.0)
    for number in range(rounds):
        trees, open_ = [Tree() for _ in range(classes)], [{0} for _ in range(classes)]
        for _ in range(depth):
            found = best_cuts(rows.where(~F.col("val")), trees, open_, bins)
            open_ = [set() for _ in range(classes)]
            for r in sorted(found, key=lambda r: (r.k, r.node)):
                open_[r.k] |= {len(trees[r.k].feature), len(trees[r.k].feature) + 1}
                trees[r.k].split(r.node, r.feature, r.bin, (rate * r.below, rate * r.above))
            if not found:
                break
        booster.rounds.append(trees)
        rows = written(_moved(rows, trees, kinds), "margins")
        own = rows.where("val") if validates else rows
        top = F.array_max("margins")
        loss = top + F.log(F.aggregate("margins", F.lit(0.0), lambda a, m: a + F.exp(m - top))) - F.get("margins", F.col("y"))
        stop.better(own.agg(F.avg(loss).alias("loss")).first().loss, number)
        if stop.over:
            break
    booster.rounds = booster.rounds[: stop.best_round + 1]
    return booster


def _moved(rows: DataFrame, trees: list[Tree], kinds: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                margins = _matrix(batch.column(1), float).copy()
                add(margins, _matrix(batch.column(0), np.int64), trees)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(margins), pa.list_(pa.float64())), *(batch.column(i) for i in (2, 3, 4))], names=["bins", "margins", "y", "val", "weight"])

    return rows.mapInArrow(run, kinds)


def with_probabilities(nodes: DataFrame, booster: Booster | None, columns: list[str]) -> DataFrame:
    """Adds probs; without a booster, all on the other class."""
    if booster is None:
        return nodes.withColumn("probs", F.array(F.lit(1.0)))
    kept = nodes.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                probs = softmax(booster.margins(booster.bins(_matrix(batch.column(len(kept)), float))))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(list(probs), pa.list_(pa.float64()))], names=[*kept, "probs"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.withColumn("_x", F.concat(*columns)).mapInArrow(run, f"{kinds}, probs array<double>")
