"""Skip-gram with negative sampling, trained in partitions whose parameters are averaged.

The corpus is spread by a hash of each sentence's key.  In a round every task starts from the same parameters, passes over its own
sentences in small batches, and gives back how it moved each vector that it touched; Spark averages these moves by token.
Both matrices are broadcast, so their size has a checked bound; sentences never leave their tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.operators.graphs import mean_vector
from weftlog.operators.models import with_unknowns
from weftlog.scratch import written

#: Bytes of both matrices at most, pairs of a batch, and sentences for each task.
MOST_BYTES, BATCH, SENTENCES = 256 << 20, 256, 20_000
#: Sentences whose pairs are formed at once.
TOGETHER = 500
#: Power of a token's count by which it is drawn as a negative.
POWER = 0.75


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(threshold, other) of each place: draw a place evenly, keep it below its threshold, else take the other one."""
    scaled = np.asarray(weights, float) * len(weights) / np.sum(weights)
    threshold, other = np.ones(len(scaled)), np.arange(len(scaled))
    small, large = list(np.flatnonzero(scaled < 1)), list(np.flatnonzero(scaled >= 1))
    while small and large:
        s, l_ = small.pop(), large[-1]
        threshold[s], other[s] = scaled[s], l_
        scaled[l_] -= 1 - scaled[s]
        if scaled[l_] < 1:
            small.append(large.pop())
    return threshold, other


def pairs(ids: np.ndarray, window: int, rng: np.random.Generator, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(centre, context) of one sentence, or of several that begin at ``starts``; each centre draws how far it sees, from 1 to ``window``."""
    reach, at = rng.integers(1, window + 1, len(ids)), np.arange(len(ids))
    bounds = np.append(np.zeros(1, int) if starts is None else starts, len(ids))
    lengths = np.diff(bounds)
    low, high = np.repeat(bounds[:-1], lengths), np.repeat(bounds[1:], lengths)
    centres, contexts = [], []
    for d in range(1, min(window, max(lengths, default=0) - 1) + 1):
        for step in (-d, d):
            ok = at[(reach >= d) & (at + step >= low) & (at + step < high)]
            centres.append(ok)
            contexts.append(ok + step)
    if not centres:
        return np.zeros(0, int), np.zeros(0, int)
    centre, context = np.concatenate(centres), np.concatenate(contexts)
    if starts is not None:  # sentence by sentence
        order = np.argsort(np.searchsorted(starts, centre, "right"), kind="stable")
        centre, context = centre[order], context[order]
    return ids[centre], ids[context]


def learn(inner: np.ndarray, outer: np.ndarray, centre: np.ndarray, context: np.ndarray, negative: np.ndarray, step: float) -> None:
    """One step on a batch of pairs, in place; a negative that is the pair's own context does not count."""
    v, targets = inner[centre], np.concatenate((context[:, None], negative), 1)
    u = outer[targets]
    wrong = 1 / (1 + np.exp(-np.clip(np.einsum("bd,bkd->bk", v, u), -30, 30)))
    wrong[:, 0] -= 1
    wrong[:, 1:][negative == context[:, None]] = 0
    np.add.at(inner, centre, -step * np.einsum("bk,bkd->bd", wrong, u))
    np.add.at(outer, targets, -step * wrong[:, :, None] * v[:, None, :])


def train(sentences: DataFrame, size: int = 64, window: int = 5, epochs: int = 15, negatives: int = 5, least: int = 2, seed: int = 17, rate: float = 0.025) -> DataFrame:
    """(token, vector) of common tokens and of the buckets, from (run_id, w_idx, entity_id, sentence).

    Equal for equal seeds: tasks are fixed by the sentences' keys.  Raises where the matrices would be larger than MOST_BYTES.
    """
    spark = sentences.sparkSession
    keys = ["run_id", "w_idx", "entity_id"]
    corpus = written(with_unknowns(sentences.where(F.size("sentence") > 1), least), "corpus")
    counts = written(corpus.select(F.explode("sentence").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    n = counts.count()
    if 2 * 8 * n * size > MOST_BYTES:
        raise ValueError(f"{n} tokens of {size} places exceed {MOST_BYTES} bytes; count more occurrences as common (least)")
    rows = counts.orderBy("token").collect()  # bounded by the line above
    tokens = [r["token"] for r in rows]
    if not tokens:
        return spark.createDataFrame([], "token string, vector array<double>")
    place, (threshold, other) = {t: i for i, t in enumerate(tokens)}, alias_table(np.array([r["n"] for r in rows], float) ** POWER)
    parts = corpus.count() // SENTENCES + 1
    spread = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(parts)).cast("int")
    corpus = written(corpus.withColumn("part", spread).repartition(parts, "part").sortWithinPartitions("part", *keys), "spread")
    rng = np.random.default_rng(seed)
    inner, outer = (rng.random((n, size)) - 0.5) / size, np.zeros((n, size))

    def passing(shared, step: float, epoch: int):
        def run(key, table):
            place, threshold, other, inner, outer = shared.value
            own, rng = (inner.copy(), outer.copy()), np.random.default_rng([seed, epoch, key[0].as_py()])
            touched = np.zeros((2, len(inner)), dtype=bool)
            order = table.sort_by([(k, "ascending") for k in keys])
            for at in range(0, order.num_rows, TOGETHER):
                said = order.column("sentence").slice(at, TOGETHER).to_pylist()
                ids = np.array([place[t] for sentence in said for t in sentence], int)
                centre, context = pairs(ids, window, rng, np.cumsum([0, *map(len, said[:-1])]))
                for lo in range(0, len(centre), BATCH):
                    c, x = centre[lo : lo + BATCH], context[lo : lo + BATCH]
                    drawn = rng.integers(0, len(threshold), (len(c), negatives))
                    drawn = np.where(rng.random(drawn.shape) < threshold[drawn], drawn, other[drawn])
                    learn(*own, c, x, drawn, step)
                    touched[0, c] = touched[1, x] = touched[1, drawn] = True
            out = [(m, i) for m in (0, 1) for i in np.flatnonzero(touched[m])]
            moves = [(own[m][i] - (inner, outer)[m][i]).tolist() for m, i in out]
            return pa.table({"matrix": pa.array([m for m, _ in out], pa.int32()), "i": pa.array([int(i) for _, i in out], pa.int32()), "move": pa.array(moves, pa.list_(pa.float64()))})

        return run

    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast((place, threshold, other, inner, outer))
        run = passing(shared, rate * max(1 - epoch / epochs, 1e-4), epoch)
        moves = corpus.groupBy("part").applyInArrow(run, "matrix int, i int, move array<double>").groupBy("matrix", "i").agg(mean_vector("move").alias("move"))
        inner, outer = inner.copy(), outer.copy()
        for r in moves.collect():  # a row for each token and matrix at most
            (inner, outer)[r["matrix"]][r["i"]] += r["move"]
        shared.destroy()
    return spark.createDataFrame([(t, v.tolist()) for t, v in zip(tokens, inner, strict=True)], "token string, vector array<double>")
