"""Toxicity scores by weak supervision.

1. Voters are mined from labelled rows: whole words (a lexicon) and word beginnings of given lengths (patterns) that toxic texts hold
   far more often than others.  A voter says toxic where its feature occurs in a text, and clean elsewhere.
2. A generative label model estimates, by expectation maximisation over the votes of labelled and unlabelled rows, how often each
   voter speaks in toxic and in clean texts, and the correlations of voters inside either class; voters that mostly speak
   together count as one, so that a word and its own beginnings do not outvote the rest.
3. A logistic regression over many word features is trained on the model's posterior labels, which for labelled rows are the labels;
   rows without one weigh less. It scores every whole text.

Nothing but the text enters a score.  Only rows that are not held out teach anything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlog.llm.storage import bounded_memory, written
from weftlog.llm.text import ALNUM, LOWER, Slice, _position_keys, mix, slices, words

#: Expected labelled documents of the sample that the regression is trained on; unlabelled ones are drawn at the same rate.
SAMPLE_DOCS = 20_000
#: Bytes of word beginnings.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Toxic texts that a feature must occur in; features counted, voters, and features of the classifier at most.
LEAST, CANDIDATES, VOTERS, FEATURES = 3, 50_000, 256, 2048
#: Log of the ratio of rates from which a feature is a voter.
STRENGTH = 2.0
#: Standard errors by which a feature that is no voter must tell the classes apart; weights of chance features drown the rest.
SURE = 2.5
#: Correlation inside a class from which voters count as one.
TOGETHER = 0.5
ROUNDS = 30
#: Weight in the regression of a row without a label: voters miss what they were not mined for, so its posterior is the weaker teacher.
UNLABELLED = 0.1


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: the checksum of the id as text is divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features_of(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of each word and each of its beginnings, with repetitions. Words are lower-cased (A-Z) alphanumeric runs."""
    w = words(piece, ALNUM, lower=True)
    data, text = LOWER[piece.data], w.texts
    texts, hashes = [text], [w.hashes]
    starts, lengths, total = w.starts, w.ends - w.starts, np.zeros(len(w.starts), np.uint64)
    keys = _position_keys(max(PREFIXES))
    for k in range(1, max(PREFIXES) + 1):
        keep = lengths >= k
        starts, lengths, text, total = starts[keep], lengths[keep], text[keep], total[keep]
        total = total + (data[starts + k - 1].astype(np.uint64) + np.uint64(1)) * keys[k - 1]
        if k in PREFIXES:
            texts.append(text)
            hashes.append(mix(total + np.uint64(1000 + k)))
    return np.concatenate(texts), np.concatenate(hashes)


def occurring(piece: Slice, known: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place in the sorted ``known``) of the known features that occur; ``few`` is a bitmap of them by 20 bits."""
    text, hashes = features_of(piece)
    maybe = few[(hashes >> np.uint64(44)).astype(np.int64)]
    text, hashes = text[maybe], hashes[maybe]
    if not len(known) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    same = known[at] == hashes
    pairs = np.unique(text[same] * len(known) + at[same])
    return pairs // len(known), pairs % len(known)


def bitmap20(known: np.ndarray) -> np.ndarray:
    few = np.zeros(1 << 20, dtype=bool)
    few[(known >> np.uint64(44)).astype(np.int64)] = True
    return few


def count_by_text(df: DataFrame, known: np.ndarray | None) -> DataFrame:
    """(hash, n): texts of ``df`` that a feature occurs in, of all features or the known ones; counted in each task first."""
    few = None if known is None else bitmap20(known)

    def run(batches):
        for batch in batches:
            for piece in slices(batch.column(0)):
                if known is None:
                    text, hashes = features_of(piece)
                    order = np.lexsort((text, hashes))
                    text, hashes = text[order], hashes[order]
                    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]))) if len(text) else np.zeros(0, bool)
                    found, n = np.unique(hashes[new], return_counts=True)
                else:
                    at, n = np.unique(occurring(piece, known, few)[1], return_counts=True)
                    found = known[at]
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    return df.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


@dataclass
class LabelModel:
    """P(toxic) and, for each group of voters, P(speaks | clean) and P(speaks | toxic)."""

    groups: np.ndarray  # group of each voter
    prior: float
    rates: np.ndarray  # (2, groups)
    correlations: np.ndarray  # (voters, voters), the larger of both classes'

    def votes(self, spoken: np.ndarray) -> np.ndarray:
        out = np.zeros((len(spoken), self.rates.shape[1]), dtype=bool)
        for v, g in enumerate(self.groups):
            out[:, g] |= spoken[:, v]
        return out

    def posterior(self, spoken: np.ndarray) -> np.ndarray:
        v = self.votes(spoken).astype(np.float64)
        log = v @ np.log(self.rates).T + (1 - v) @ np.log(1 - self.rates).T + np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


def _fit_rates(votes: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    weight = np.stack((1 - toxic, toxic)) * n
    rates = (weight @ votes + 0.1) / (weight.sum(1, keepdims=True) + 10)
    return float(((toxic * n).sum() + 1) / (n.sum() + 2)), np.clip(rates, 1e-4, 1 - 1e-4)


def fit_label_model(spoken: np.ndarray, label: np.ndarray, n: np.ndarray) -> LabelModel:
    """Expectation maximisation over rows that stand for ``n`` each; ``label`` is 0, 1 or -1 (none), and known labels start it and stay."""
    known = label >= 0

    def correlate(toxic: np.ndarray) -> np.ndarray:
        out = np.zeros((spoken.shape[1],) * 2)
        for weight in ((1 - toxic) * n, toxic * n):
            if weight.sum() > 1:
                centred = spoken - (weight @ spoken) / weight.sum()
                cov = (centred * weight[:, None]).T @ centred / weight.sum()
                scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                out = np.maximum(out, cov / np.outer(scale, scale))
        return out

    def run(groups: np.ndarray) -> tuple[LabelModel, np.ndarray]:
        model = LabelModel(groups, 0.5, np.zeros((2, groups.max(initial=-1) + 1)), np.zeros((0, 0)))
        votes = model.votes(spoken).astype(np.float64)
        model.prior, model.rates = _fit_rates(votes[known], label[known].astype(float), n[known])
        for _ in range(ROUNDS):
            toxic = np.where(known, label, model.posterior(spoken))
            model.prior, model.rates = _fit_rates(votes, toxic, n)
        return model, toxic

    model, toxic = run(np.arange(spoken.shape[1]))
    correlations = correlate(toxic)
    groups = np.full(spoken.shape[1], -1)
    for v in range(len(groups)):  # voters come strongest first
        if groups[v] < 0:
            groups[v] = groups.max() + 1
            groups[(groups < 0) & (correlations[v] >= TOGETHER)] = groups[v]
    model, _ = run(groups)
    model.correlations = correlations
    return model


@dataclass
class Scorer:
    """A linear classifier over features that occur in a text."""

    known: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, piece: Slice, few: np.ndarray) -> np.ndarray:
        text, at = occurring(piece, self.known, few)
        margin = self.intercept + np.bincount(text, self.weights[at], minlength=piece.hi - piece.lo)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Fit on all documents that are not held out, the regression on a sample of them with about SAMPLE_DOCS labelled ones.

    Without labels of both kinds every score is the share of toxic ones (0 without any).
    """
    bounded_memory(docs.sparkSession)
    taught = labels.where(~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).where("label is not null")
    teaching = docs.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # texts meet labels by a sort on every size of input: the labels grow with the texts, so none is too small to count on and none large enough to break a broadcast
    labelled = written(teaching.join(taught.hint("merge"), "id").select("text", "label"), "toxicity-labelled")
    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        rate = float(np.clip(toxic / max(1, clean + toxic), 1e-6, 1 - 1e-6))
        return Scorer(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))))

    in_toxic = count_by_text(labelled.where("label = 1"), None).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "hash").limit(CANDIDATES).collect()
    known = np.sort(np.array([r["hash"] for r in in_toxic], np.int64).astype(np.uint64))
    of = {int(np.uint64(r["hash"] & 0xFFFFFFFFFFFFFFFF)): r["n"] for r in in_toxic}
    positive = np.array([of[int(x)] for x in known], float)
    negative = np.zeros(len(known))
    for r in count_by_text(labelled.where("label = 0"), known).collect():  # CANDIDATES at most
        negative[np.searchsorted(known, np.uint64(r["hash"] & 0xFFFFFFFFFFFFFFFF))] = r["n"]
    strength = np.log((positive + 0.5) / (toxic + 1)) - np.log((negative + 0.5) / (clean + 1))
    gain = positive * np.maximum(strength, 0)
    voters = np.argsort(-np.where(strength >= STRENGTH, gain, 0), kind="stable")[:VOTERS]
    voters = voters[strength[voters] >= STRENGTH]
    sure = np.abs(strength) / np.sqrt(1 / (positive + 0.5) + 1 / (negative + 0.5))
    others = np.argsort(-np.abs(strength) * np.sqrt(positive + negative), kind="stable")
    chosen = np.sort(np.unique(np.concatenate((voters, others[sure[others] >= SURE][: FEATURES - len(voters)]))))
    table, few = known[chosen], bitmap20(known[chosen])

    def present(batches):
        for batch in batches:
            for piece in slices(batch.column(0)):
                text, at = occurring(piece, table, few)
                per = np.bincount(text, minlength=piece.hi - piece.lo)
                found = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1)[piece.lo : piece.hi], found], names=["id", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    marked = teaching.select("text", "id").mapInArrow(present, f"id {kind}, found array<int>").join(taught.hint("merge"), "id", "left")
    seen = written(marked.select("id", F.coalesce("label", F.lit(-1)).alias("label"), "found"), "toxicity-features")

    # how often all documents vote alike, as places among the voters
    place = {int(np.searchsorted(chosen, v)): i for i, v in enumerate(voters)}
    own = F.array(*[F.lit(i) for i in place]) if place else F.array().cast("array<int>")
    rows = seen.select("label", F.array_intersect("found", own).alias("votes")).groupBy("label", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    spoken, label = np.zeros((len(rows), max(1, len(voters))), dtype=bool), np.array([r["label"] for r in rows], int)
    for at, r in enumerate(rows):
        spoken[at, [place[v] for v in r["votes"]]] = True
    model = fit_label_model(spoken, label, np.array([r["n"] for r in rows], float))

    patterns, which = np.unique(spoken, axis=0, return_index=True)
    posterior = {tuple(sorted(v for v, i in place.items() if p[i])): float(x) for p, x in zip(patterns, model.posterior(patterns), strict=True)}
    vector = F.udf(lambda found: SparseVector(len(table), [int(x) for x in found], [1.0] * len(found)), VectorUDT())
    votes_of = frozenset(place)
    # what the model believes of a row, given its votes and, where it is known, its label
    weigh = F.udf(lambda found, label: float(label) if label >= 0 else posterior.get(tuple(x for x in found if x in votes_of), 0.5), T.DoubleType())
    drawn = seen.where(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1_000_000)) < int(1e6 * min(1.0, SAMPLE_DOCS / (clean + toxic))))
    soft = drawn.select(vector("found").alias("features"), weigh("found", "label").alias("p"), F.when(F.col("label") < 0, UNLABELLED).otherwise(1.0).alias("trust"))
    taught = soft.select("features", F.lit(1.0).alias("label"), (F.col("trust") * F.col("p")).alias("weight")).union(soft.select("features", F.lit(0.0), F.col("trust") * (1 - F.col("p")))).where("weight > 0.0001")
    taught = written(taught, "toxicity-training")
    line = LogisticRegression(maxIter=40, regParam=1e-4, standardization=False, weightCol="weight").fit(taught)
    return Scorer(table, line.coefficients.toArray(), float(line.intercept))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row. A null text is scored as an empty one; repeated rows and null ids are scored each."""
    few = bitmap20(scorer.known)

    def run(batches):
        for batch in batches:
            for piece in slices(batch.column(2)):
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[piece.lo : piece.hi] for c in range(2)), pa.array(scorer.score(piece, few))], names=["id", "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents that score under ``threshold``, with all their columns as they are."""
    scorer = fit(docs, labels)
    few = bitmap20(scorer.known)

    def run(batches):
        for batch in batches:
            column = batch.schema.get_field_index("text")
            keep = [scorer.score(piece, few) < threshold for piece in slices(batch.column(column))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op4_weak_supervision(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
