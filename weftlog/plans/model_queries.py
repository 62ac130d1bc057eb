"""Queries on learned stages; rows only, as weights depend on the machine's order of sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlog.operators import graphs, models, sentences, skipgram, stats, windows
from weftlog.plans.registry import query
from weftlog.plans.testdata import WINDOWS, entities, telemetry
from weftlog.scratch import written


def _events(spark, sf_dir):
    """What these queries use of events, with tokens: the table is read and its tokens are made once."""
    used = ["run_id", "ts_us", "ord", "event_type", "src_id", "src_type", "dst_id", "dst_type", "dst_svc_id", "tokens_out", "tokens_in"]
    return written(sentences.tokenised(telemetry(spark, sf_dir)).select(*used), "tokenised")


def _sentences(place):
    return written(sentences.sentences(place), "sentences")


def _encoded(place):
    said = _sentences(place)
    vectors = models.token_vectors(said, size=16, epochs=1)
    return models.encoded(said, vectors, 16)


@query()
def w2v_embed(spark, sf_dir):
    """Sentences as vectors."""
    return _encoded(windows.assign_windows(_events(spark, sf_dir), WINDOWS)).select("run_id", "w_idx", "entity_id", F.transform("x", lambda v: F.round(v, 4)).alias("x"))


@query()
def skipgram_vectors(spark, sf_dir):
    """Vectors of all sentences' tokens by negative sampling (M01); tests/test_skipgram.py checks its steps and neighbours."""
    said = _sentences(windows.assign_windows(_events(spark, sf_dir), WINDOWS))
    return skipgram.train(said, size=16, epochs=1).select("token", F.transform("vector", lambda v: F.round(v, 6)).alias("vector"))


@query()
def role_scores(spark, sf_dir):
    """Role scores of nodes from vectors propagated over window graphs."""
    events = _events(spark, sf_dir)
    place, ents = windows.assign_windows(events, WINDOWS), written(entities(events), "entities")
    nodes = graphs.incident_nodes(place, ents).join(_encoded(place), ["run_id", "w_idx", "entity_id"])
    full = graphs.propagated(graphs.window_edges(place, ents), nodes, ["run_id", "w_idx"], width=16)
    vocabulary = written(stats.label_vocabulary(ents), "vocabulary")  # a row for each role, so nodes need no shuffle to meet it
    labelled = written(stats.with_label_index(full, vocabulary), "features")
    model = models.role_regression(labelled, ["x", "x1", "x2"], iterations=10)
    return models.node_scores(models.probabilities(labelled, model, ["x", "x1", "x2"]), vocabulary).withColumn("score_raw", F.round("score_raw", 4)).drop("p_true")
