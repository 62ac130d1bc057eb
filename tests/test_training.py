"""Supervision of links, losses, message passing and distributed training."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlog import scratch
from weftlog.operators import links, losses, memory, messages, training
from weftlog.operators.training import Adam, EarlyStop

EDGE = "run_id string, pos long, later long, relation string, src string, dst string"


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGE)


@pytest.fixture(scope="module")
def typed(spark):
    rows = []
    for g in range(12):
        for e in range(10):
            for n in {(e * 7 + g) % 6, (e * 3 + 1) % 6}:
                rows += [("r", g, g, "src_of", f"n{n}", f"e{e}"), ("r", g, g, "rev_src_of", f"e{e}", f"n{n}")]
            if e:
                rows.append(("r", g, g, "follows_src", f"e{e - 1}", f"e{e}"))
        rows += [("r", g, g + 1, "recurs", f"n{n}", f"n{n}") for n in range(6)]
    return edges(spark, rows)


def test_mirrored_links_are_held_together(spark, typed):
    rows = {(r.pos, r.relation, r.src, r.dst): r.held for r in links.supervised(typed, 0.3).collect()}
    assert all(rows[(p, "rev_src_of", d, s)] == held for (p, rel, s, d), held in rows.items() if rel == "src_of")
    assert 0.2 < sum(rows.values()) / len(rows) < 0.4
    other = {(r.pos, r.relation, r.src, r.dst): r.held for r in links.supervised(typed, 0.3, seed=4).collect()}
    assert other != rows


@pytest.mark.parametrize("most", [0, 1, 7, 50, 10_000])
def test_smallest_equals_sorting(spark, typed, most):
    number = links.draw(3, *map(F.col, ("pos", "src", "dst")))
    got = {tuple(r) for r in links.smallest(typed, "relation", number, most, "pos", "src", "dst").select(typed.columns).collect()}
    rows = sorted((r.relation, r.n, r.pos, r.src, r.dst, r.later) for r in typed.withColumn("n", number).collect())
    want = set()
    for relation in {r[0] for r in rows}:
        want |= {("r", p, later, rel, s, d) for rel, _, p, s, d, later in [r for r in rows if r[0] == relation][:most]}
    assert got == want


def test_smallest_with_one_number_for_all(spark, typed):
    """Ties in the number are broken by the columns given."""
    got = sorted((r.relation, r.pos, r.src, r.dst) for r in links.smallest(typed, "relation", F.lit(5).cast("long"), 3, "pos", "src", "dst").collect())
    rows = sorted((r.relation, r.pos, r.src, r.dst) for r in typed.collect())
    assert got == [x for rel in sorted({r[0] for r in rows}) for x in [r for r in rows if r[0] == rel][:3]]


def test_negatives_are_of_the_relation_and_no_edges(spark, typed):
    positives = typed.where(F.col("pos") < 6)
    known = {tuple(r) for r in typed.collect()}
    for ratio in (1, 3):
        out = [tuple(r[c] for c in ("run_id", "pos", "later", "relation", "src", "dst")) for r in links.relation_negatives(positives, typed, ratio).collect()]
        assert len(out) == len(set(out)) and not set(out) & known
        for run, pos, later, rel, src, dst in out:
            own = [k for k in known if k[:4] == (run, pos, later, rel)]
            assert src in {k[4] for k in own} and dst in {k[5] for k in own} and src != dst
        assert len(out) > 0.6 * positives.count()


def test_complete_graph_has_no_negatives(spark):
    full = edges(spark, [("r", 0, 0, "src_of", f"n{i}", f"e{j}") for i in range(3) for j in range(3)])
    assert links.relation_negatives(full, full).count() == 0
    nearly = full.where("src <> 'n2' OR dst <> 'e2'")
    assert [(r.src, r.dst) for r in links.relation_negatives(nearly, nearly, tries=40).collect()] == [("n2", "e2")]


def test_losses(spark):
    rows = [("a", 2.0, True), ("a", -1.0, False), ("a", 800.0, False), ("b", 0.5, True), ("c", 1.0, False)]
    df = spark.createDataFrame(rows, "relation string, logit double, positive boolean")
    bce = lambda x, y: max(x, 0) - x * y + math.log1p(math.exp(-abs(x)))
    want = {r: np.mean([bce(x, y) for q, x, y in rows if q == r]) for r in "abc"}
    got = {r.relation: r.loss for r in losses.relation_losses(df, "logit", "positive").collect()}
    assert got == pytest.approx(want)
    macro = losses.macro_link_loss(df, "logit", "positive").first()
    assert macro.relations == 2 and macro.loss == pytest.approx((want["a"] + want["b"]) / 2)
    assert losses.macro_link_loss(df.limit(0), "logit", "positive").first().loss is None
    none = spark.createDataFrame([([1.0], 0, 1.0)], "probs array<double>, y int, weight double")
    assert losses.class_loss(none, "probs", "y", "weight").first().loss == 0.0


def test_chains_stand_for_their_edges(spark):
    """Frames over the ends of events say what the edges between them say, in vectors summed by place or whole."""
    events = [("r", i % 2, f"e{i}", i, f"a{i % 3}", f"b{i % 4 // 3}") for i in range(40)]
    ends = spark.createDataFrame(events, "run_id string, pos long, event_id string, order int, src_id string, dst_id string")
    follows = memory.follow_edges(ends, 3).select("run_id", "pos", F.col("pos").alias("later"), F.col("edge_type").alias("relation"), "src", "dst")
    for width in (3, messages.NARROW + 1):
        nodes = ends.select("run_id", "pos", F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.array(*[F.sin(F.col("order") * (i + 1.0)) for i in range(width)]).alias("x"))
        found = lambda out: {(r.pos, r.id): r.x for r in out.collect()}
        wanted = found(messages.layer(nodes, messages.weighted(follows), width))
        got = found(messages.layer(nodes, messages.weighted(follows.limit(0)), width, memory.follow_ends(ends), 3))
        assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k], abs=1e-12) for k in wanted)


def test_typed_pass_by_hand(spark):
    nodes = spark.createDataFrame([("r", 0, "event", "e0", [1.0, 2.0]), ("r", 0, "event", "e1", [3.0, -4.0]), ("r", 0, "event", "e2", [-5.0, 6.0]), ("r", 0, "entity", "n", [1.0, 0.0]), ("r", 1, "entity", "n", [0.0, 1.0])], "run_id string, pos long, kind string, id string, x array<double>")
    rows = [("r", 0, 0, "follows_src", "e0", "e2"), ("r", 0, 0, "follows_src", "e1", "e2"), ("r", 0, 0, "follows_dst", "e1", "e2"), ("r", 0, 1, "recurs", "n", "n")]
    out = {(r.pos, r.id): r.x for r in messages.typed_pass(nodes, messages.weighted(edges(spark, rows)), memory.TEMPORAL, 2).collect()}
    assert out[(0, "e0")] == pytest.approx([2, 4]) and out[(0, "e1")] == pytest.approx([6, -0.08]) and out[(0, "n")] == pytest.approx([1, 0])
    # e2: twice its own (two relations reach events), the mean of e0 and e1 not rotated (4 steps of 2), that of e1 by one place
    assert out[(0, "e2")] == pytest.approx([(-10 + 2 - 4) * 0.01, 12 - 1 + 3])
    assert out[(1, "n")] == pytest.approx([0 + 1, 2 * 0.5 + 0])  # recurs is the only temporal relation of entities
    scaled = messages.scaled(nodes, {"event": ([1.0, 1.0], [2.0, 1.0])})
    assert {r.id: r.x for r in scaled.collect() if r.kind == "event"}["e1"] == [1.0, -5.0]


def test_early_stop_on_a_made_up_curve(spark, tmp_path):
    curve = [1.0, 0.8, 0.7999, 0.79995, 0.6, 0.61, 0.6001, 0.59995, 0.2]
    at = iter(curve)
    params = {"w": np.zeros(1)}
    seen = []

    def job(p):
        seen.append(float(p["w"][0]))
        return 0.0, next(at), {"w": np.array([-1.0])}

    best, losses_ = training.descend(spark, params, job, 100, Adam(1.0), EarlyStop(3), str(tmp_path))
    assert losses_ == curve[:8]  # 0.59995 is less than 1e-4 better than 0.6, so three rounds after round 4 have waited
    assert float(best["w"][0]) == seen[4]
    assert [float(training.kept_round(spark, str(tmp_path), i)["w"][0]) for i in range(8)] == seen
    assert training.descend(spark, params, job, 0, Adam(1.0), EarlyStop(3))[0] is params


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        relation = messages.RELATIONS[i % 7] if i % 3 else "src_of"
        a, b = rng.standard_normal(4), rng.standard_normal(4)
        rows.append((relation, a.tolist(), b.tolist(), bool(a[0] + b[1] > 0), i % 5 == 0))
    return spark.createDataFrame(rows, "relation string, x_src array<double>, x_dst array<double>, positive boolean, val boolean").repartition(3)


def test_gradients_agree_with_differences(spark, pairs):
    rows = training.macro_weights(pairs, ["relation"]).select("relation", "x_src", "x_dst", "positive", "val", "weight")
    params = training.new_encoder(4, 3) | training.new_decoders(3)
    batch = rows.toArrow().combine_chunks().to_batches()[0]
    train, val, gradient = training.link_sums(batch, params)
    far = training.loss_and_gradient(rows, training.link_sums, params)
    assert far[0] == pytest.approx(train) and far[1] == pytest.approx(val) and np.allclose(training.flat(far[2]), training.flat(gradient))
    nodes = pa.RecordBatch.from_pydict({"x": [[0.5, -1.0, 2.0, 0.1], [1.0, 1.0, -0.3, 0.0]], "y": [1, 2], "val": [False, False], "weight": [0.3, 0.7]})
    head = training.new_encoder(4, 3) | training.new_head(3, 3)
    for sums, data, p in ((training.link_sums, batch, params), (training.class_sums, nodes, head)):
        _, _, exact = sums(data, p)
        for name in p:
            for at in list(np.ndindex(p[name].shape))[:5]:
                moved = {k: v.copy() for k, v in p.items()}
                moved[name][at] += 1e-6
                up = sums(data, moved)[0]
                moved[name][at] -= 2e-6
                assert (up - sums(data, moved)[0]) / 2e-6 == pytest.approx(exact[name][at], abs=1e-6)


def test_relations_weigh_alike(spark, pairs):
    sums = training.macro_weights(pairs, ["relation"]).groupBy("val", "relation").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(1 / 7) for r in sums) and len(sums) == 14


def test_pretraining_learns_and_is_reproduced_by_a_warm_start(spark, pairs):
    params, seen = training.pretrain(pairs, 4, 6, 25, 0.1, 25)
    assert min(seen) < seen[0] - 0.1
    again, _ = training.pretrain(pairs, 4, 6, 25, 0.1, 25)
    assert np.allclose(training.flat(params), training.flat(again))
    nodes = spark.createDataFrame([([0.1 * i, 1.0, -0.2 * i, 0.5], i % 3, i % 4 == 0) for i in range(60)], "x array<double>, y int, val boolean")
    tuned, _ = training.finetune(nodes, 4, 6, 3, 0, params, 1e-2, 1e-3, 5e-4, 5)
    assert all(np.array_equal(tuned[k], params[k]) for k in params if not k.startswith("link_"))
    scores = training.with_logits(pairs, params).select("logit")
    same = training.with_logits(pairs, tuned | {k: v for k, v in params.items() if k.startswith("link_")}).select("logit")
    assert sorted(r.logit for r in scores.collect()) == sorted(r.logit for r in same.collect())
    # step sizes differ with and without pretrained parameters
    for start, rate in ((params, 1e-2), (None, 1e-3)):
        one, _ = training.finetune(nodes, 4, 6, 3, 1, start, 1e-2, 1e-3, 0.0, 5)
        zero, _ = training.finetune(nodes, 4, 6, 3, 0, start, 1e-2, 1e-3, 0.0, 5)
        moved = np.abs(one["head_w"] - zero["head_w"]).max()
        assert moved == 0 or moved == pytest.approx(rate, rel=1e-3)
    probs = training.with_probabilities(nodes, tuned).collect()
    assert all(sum(r.probs) == pytest.approx(1) for r in probs) and len(probs) == 60


def test_parameters_and_texts_survive_a_round_trip(spark, tmp_path):
    params = training.new_encoder(3, 2) | training.new_decoders(2)
    back = training.from_json(training.as_json(params))
    assert set(back) == set(params) and all(np.array_equal(back[k], params[k]) for k in params)
    uri = f"file://{tmp_path}/a/b.json"
    for text in (json.dumps({"é": 1}), "second"):
        scratch.write_text(spark, uri, text)
        assert scratch.read_text(spark, uri) == text


def test_edges_are_met_once_for_all_draws(spark, monkeypatch):
    """Draws that hit edges cost no further pass over them: the tables written do not grow with the tries."""
    names, own = [], links.written
    monkeypatch.setattr(links, "written", lambda df, name: names.append(name) or own(df, name))
    # all pairs of 4 ends but (3, 3) are edges, so most draws hit
    edges = spark.createDataFrame([("r", 0, 0, "x", f"s{a}", f"d{b}") for a in range(4) for b in range(4) if (a, b) != (3, 3)], "run_id string, pos long, later long, relation string, src string, dst string")
    found = links.relation_negatives(edges, edges, 1, 17, 40).collect()
    assert [(r.src, r.dst) for r in found] == [("s3", "d3")]
    assert sorted(names) == sorted(set(names)) and len(names) == 6
