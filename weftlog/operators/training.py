"""Training by distributed gradients: an encoder that link prediction pretrains and role classification goes on with.

A round is one job: tasks compute the sums of losses and gradients of their rows, which Spark adds up, and the driver takes one step of
the few parameters.  Parameters are written each round, so a run can go on where it stopped, and a loss that stops falling ends it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.operators.messages import ENDS, KINDS, RELATIONS
from weftlog.scratch import read_text, write_text, written

#: Numbers of a gradient that travel as one row.
BLOCK = 1024
SLOPE = 0.01

Parameters = dict[str, np.ndarray]


@dataclass
class EarlyStop:
    """Keeps the best loss; a round that is not better by ``least_gain`` counts as waiting, and ``patience`` of them in a row end the run."""

    patience: int
    least_gain: float = 1e-4
    best: float = float("inf")
    best_round: int = -1
    waited: int = 0

    def better(self, loss: float, number: int) -> bool:
        if loss < self.best - self.least_gain:
            self.best, self.best_round, self.waited = loss, number, 0
            return True
        self.waited += 1
        return False

    @property
    def over(self) -> bool:
        return self.waited >= self.patience


@dataclass
class Adam:
    """Steps by running means of the gradient and its square; weights decay towards 0 as part of the gradient."""

    rate: float
    decay: float = 0.0
    beta: tuple[float, float] = (0.9, 0.999)
    steps: int = 0
    first: Parameters = field(default_factory=dict)
    second: Parameters = field(default_factory=dict)

    def step(self, params: Parameters, gradient: Parameters) -> Parameters:
        self.steps += 1
        out, (b1, b2) = {}, self.beta
        for name, value in params.items():
            g = gradient[name] + self.decay * value
            self.first[name] = b1 * self.first.get(name, 0.0) + (1 - b1) * g
            self.second[name] = b2 * self.second.get(name, 0.0) + (1 - b2) * g * g
            m, v = self.first[name] / (1 - b1**self.steps), self.second[name] / (1 - b2**self.steps)
            out[name] = value - self.rate * m / (np.sqrt(v) + 1e-8)
        return out


def flat(params: Parameters) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)]) if params else np.zeros(0)


def shaped(values: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def as_json(params: Parameters) -> str:
    return json.dumps({k: {"shape": list(v.shape), "values": v.ravel().tolist()} for k, v in params.items()})


def from_json(text: str) -> Parameters:
    return {k: np.array(v["values"], float).reshape(v["shape"]) for k, v in json.loads(text).items()}


def loss_and_gradient(rows: DataFrame, batch_sums: Callable, params: Parameters) -> tuple[float, float, Parameters]:
    """(loss of training rows, loss of validation rows, gradient of the former): one job, of which some blocks of numbers reach the driver.

    ``batch_sums(batch, params)`` gives a batch's weighted loss of both kinds and the gradient of the first.  ``rows`` carry their weights, which
    add up to 1 for each kind, so sums are means.
    """

    def run(batches):
        total, losses = np.zeros(sum(v.size for v in params.values())), np.zeros(2)
        for batch in batches:
            if batch.num_rows:
                train, val, gradient = batch_sums(batch, params)
                losses += (train, val)
                total += flat(gradient)
        every = np.concatenate((losses, total))
        blocks = [every[i : i + BLOCK] for i in range(0, len(every), BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.list_(pa.float64()))], names=["block", "part"])

    sums = rows.mapInArrow(run, "block int, part array<double>").groupBy("block").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
    parts = {r.block: r.part for r in sums.collect()}
    every = np.concatenate([parts[i] for i in range(len(parts))]) if parts else np.zeros(2 + sum(v.size for v in params.values()))
    return float(every[0]), float(every[1]), shaped(every[2:], params)


def descend(spark: SparkSession, params: Parameters, job: Callable[[Parameters], tuple[float, float, Parameters]], rounds: int, optimiser: Adam, stop: EarlyStop, folder: str | None = None) -> tuple[Parameters, list[float]]:
    """(best parameters, validation losses): at most ``rounds`` steps, fewer where the validation loss stops falling.

    ``job`` gives both losses and the gradient at some parameters; the loss that is judged is that of the parameters that gave it.  With 0 rounds
    the parameters are returned as they came.  Each round's parameters are written to ``folder``.
    """
    best, losses = params, []
    for number in range(rounds + 1):
        if rounds == 0:
            break
        _, val, gradient = job(params)
        losses.append(val)
        if stop.better(val, number):
            best = params
        if folder:
            write_text(spark, f"{folder}/round-{number:04d}.json", json.dumps({"loss": val, "best_round": stop.best_round, "params": json.loads(as_json(params))}))
        if stop.over or number == rounds:
            break
        params = optimiser.step(params, gradient)
    return best, losses


def kept_round(spark: SparkSession, folder: str, number: int) -> Parameters:
    """Parameters as a round left them."""
    return from_json(json.dumps(json.loads(read_text(spark, f"{folder}/round-{number:04d}.json"))["params"]))


# ---------------------------------------------------------------- the network


def new_encoder(width: int, hidden: int, seed: int = 17) -> Parameters:
    """One hidden layer for each kind of node, drawn from the seed."""
    rng = np.random.default_rng(seed)
    return {f"{kind}_w": rng.standard_normal((width, hidden)) / np.sqrt(width) for kind in KINDS} | {f"{kind}_b": np.zeros(hidden) for kind in KINDS}


def new_decoders(hidden: int, seed: int = 17) -> Parameters:
    """One decoder for each relation over both ends and their product: relations are asymmetric, so a product alone would not do."""
    rng = np.random.default_rng(seed + 1)
    return {f"link_{r}": np.append(rng.standard_normal(3 * hidden) / np.sqrt(3 * hidden), 0.0) for r in RELATIONS}


def new_head(hidden: int, classes: int, seed: int = 17) -> Parameters:
    rng = np.random.default_rng(seed + 2)
    return {"head_w": rng.standard_normal((hidden, classes)) / np.sqrt(hidden), "head_b": np.zeros(classes)}


def _hidden(x: np.ndarray, params: Parameters, kind: str) -> tuple[np.ndarray, np.ndarray]:
    z = x @ params[f"{kind}_w"] + params[f"{kind}_b"]
    slope = np.where(z >= 0, 1.0, SLOPE)
    return z * slope, slope


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def link_logits(x_src: np.ndarray, x_dst: np.ndarray, relation: str, params: Parameters) -> np.ndarray:
    (a, _), (b, _) = _hidden(x_src, params, ENDS[relation][0]), _hidden(x_dst, params, ENDS[relation][1])
    w = params[f"link_{relation}"]
    return np.concatenate((a, b, a * b), axis=1) @ w[:-1] + w[-1]


def link_sums(batch: pa.RecordBatch, params: Parameters) -> tuple[float, float, Parameters]:
    """Sums of a batch of pairs: relation, x_src, x_dst, positive, val, weight."""
    out = {k: np.zeros_like(v) for k, v in params.items()}
    relation, positive, val, weight = (np.asarray(batch.column(i)) for i in (0, 3, 4, 5))
    xs, xd, losses = _rows(batch.column(1)), _rows(batch.column(2)), [0.0, 0.0]
    for r in np.unique(relation):
        at = np.flatnonzero(relation == r)
        (one, two), w = ENDS[r], params[f"link_{r}"]
        (a, slope_a), (b, slope_b) = _hidden(xs[at], params, one), _hidden(xd[at], params, two)
        both = np.concatenate((a, b, a * b), axis=1)
        logit, y, held = both @ w[:-1] + w[-1], positive[at].astype(float), val[at].astype(bool)
        loss = weight[at] * (np.maximum(logit, 0) - logit * y + np.log1p(np.exp(-np.abs(logit))))
        losses[0] += loss[~held].sum()
        losses[1] += loss[held].sum()
        g = np.where(held, 0.0, weight[at] * (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y))
        out[f"link_{r}"] += np.append(both.T @ g, g.sum())
        h = a.shape[1]
        back = g[:, None] * w[None, :-1]
        d_a, d_b = (back[:, :h] + back[:, 2 * h :] * b) * slope_a, (back[:, h : 2 * h] + back[:, 2 * h :] * a) * slope_b
        for kind, x, d in ((one, xs[at], d_a), (two, xd[at], d_b)):
            out[f"{kind}_w"] += x.T @ d
            out[f"{kind}_b"] += d.sum(axis=0)
    return losses[0], losses[1], out


def class_probabilities(x: np.ndarray, params: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z, slope = _hidden(x, params, "entity")
    logits = z @ params["head_w"] + params["head_b"]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True), z, slope


def class_sums(batch: pa.RecordBatch, params: Parameters) -> tuple[float, float, Parameters]:
    """Sums of a batch of nodes: x, y, val, weight."""
    out = {k: np.zeros_like(v) for k, v in params.items()}
    x = _rows(batch.column(0))
    y, val, weight = (np.asarray(batch.column(i)) for i in (1, 2, 3))
    probs, z, slope = class_probabilities(x, params)
    at, held = (np.arange(len(y)), y.astype(int)), val.astype(bool)
    loss = weight * -np.log(np.maximum(probs[at], 1e-12))
    g = probs.copy()
    g[at] -= 1
    g *= np.where(held, 0.0, weight)[:, None]
    out["head_w"], out["head_b"] = z.T @ g, g.sum(axis=0)
    d = (g @ params["head_w"].T) * slope
    out["entity_w"], out["entity_b"] = x.T @ d, d.sum(axis=0)
    return float(loss[~held].sum()), float(loss[held].sum()), out


def macro_weights(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Adds weight: rows of a part (val or not) weigh 1 together, its groups alike, and a group's rows alike."""
    counts = pairs.groupBy("val", *by).agg(F.count(F.lit(1)).alias("_n"))
    groups = counts.groupBy("val").agg(F.count(F.lit(1)).alias("_groups"))
    sizes = counts.join(groups, "val").select("val", *by, (1 / (F.col("_n") * F.col("_groups"))).alias("weight"))
    return pairs.join(sizes, ["val", *by])


def _job(rows: DataFrame, batch_sums: Callable) -> Callable[[Parameters], tuple[float, float, Parameters]]:
    """The job of a round; without rows to validate on, the training loss is judged."""
    validates = not rows.where("val").isEmpty()

    def job(params: Parameters) -> tuple[float, float, Parameters]:
        train, val, gradient = loss_and_gradient(rows, batch_sums, params)
        return train, val if validates else train, gradient

    return job


def pretrain(pairs: DataFrame, width: int, hidden: int, rounds: int, rate: float, patience: int, seed: int = 17, folder: str | None = None) -> tuple[Parameters, list[float]]:
    """Encoder and decoders from pairs (relation, x_src, x_dst, positive, val): the loss is the mean over relations of their mean losses."""
    rows = written(macro_weights(pairs, ["relation"]).select("relation", "x_src", "x_dst", "positive", "val", "weight"), "pairs")
    start = new_encoder(width, hidden, seed) | new_decoders(hidden, seed)
    return descend(pairs.sparkSession, start, _job(rows, link_sums), rounds, Adam(rate), EarlyStop(patience), folder)


def finetune(nodes: DataFrame, width: int, hidden: int, classes: int, rounds: int, start: Parameters | None, rate: float, scratch_rate: float, decay: float, patience: int, seed: int = 17, folder: str | None = None) -> tuple[Parameters, list[float]]:
    """Encoder and head from nodes (x, y, val) that have a class, weighed by class.

    The encoder starts from pretrained parameters, at step size ``rate``, or from the seed, at ``scratch_rate``; the head always starts from the seed.
    """
    encoder = {k: v for k, v in (start or new_encoder(width, hidden, seed)).items() if not k.startswith("link_")}
    params = encoder | new_head(hidden, classes, seed)
    rows = written(macro_weights(nodes.where(F.col("y") > 0), ["y"]).select("x", "y", "val", "weight"), "labelled")
    optimiser = Adam(rate if start is not None else scratch_rate, decay)
    return descend(nodes.sparkSession, params, _job(rows, class_sums), rounds, optimiser, EarlyStop(patience), folder)


def with_logits(pairs: DataFrame, params: Parameters) -> DataFrame:
    """Adds logit to pairs (relation, x_src, x_dst) and drops the vectors."""
    kept = [c for c in pairs.columns if c not in ("x_src", "x_dst")]

    def run(batches):
        for batch in batches:
            relation, xs, xd = np.asarray(batch.column("relation")), batch.column("x_src"), batch.column("x_dst")
            out = np.zeros(batch.num_rows)
            for r in np.unique(relation):
                at = pa.array(np.flatnonzero(relation == r))
                out[at.to_numpy()] = link_logits(_rows(xs.take(at)), _rows(xd.take(at)), str(r), params)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out)], names=[*kept, "logit"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name in kept)
    return pairs.mapInArrow(run, f"{kinds}, logit double")


def with_probabilities(nodes: DataFrame, params: Parameters) -> DataFrame:
    """Adds probs to nodes with x, and drops it."""
    kept = [c for c in nodes.columns if c != "x"]

    def run(batches):
        for batch in batches:
            probs = class_probabilities(_rows(batch.column("x")), params)[0] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(list(probs), pa.list_(pa.float64()))], names=[*kept, "probs"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields if f.name in kept)
    return nodes.mapInArrow(run, f"{kinds}, probs array<double>")
