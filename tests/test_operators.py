import math
import random

import pytest
from pyspark.sql import functions as F

from weftlog import config
from weftlog.functions import encoding, net, tokens
from weftlog.operators import alerts, memory, perturb, sentences, splits, stats, windows
from weftlog.schema import as_events


def events(spark, rows):
    """Events from dictionaries; times in seconds."""
    return as_events(spark.createDataFrame([{"run_id": "r", "event_id": f"e{i:03d}", "ord": i, "event_type": "RPC_CALL", "src_type": "Pod", "dst_type": "Pod"} | r for i, r in enumerate(rows)]))


def pods(spark, *names):
    return spark.createDataFrame([("r", n, "Pod", n[-1], "default") for n in names], "run_id string, entity_id string, entity_type string, canonical_service string, namespace string")


def literal_windows(times, width, stride, tail):
    """The rule, word for word, in integers."""
    out, t0, n, end = [], times[0], 0, times[-1]
    while t0 <= end:
        t1 = t0 + width
        if t1 > end and n and min(t1, end) - t0 < tail:
            break
        inside = [t for t in times if t0 <= t < t1]
        if inside:
            out.append((n, (t0 - times[0]) // stride, len(inside)))
            n += 1
        if t1 > end:
            break
        t0 += stride
    return out


def test_windows_against_the_literal_rule(spark):
    rng = random.Random(5)
    for width, stride, tail in ((30, 15, 15), (5, 5, 3), (10, 4, 7), (7, 7, 0)):
        rows, expected = [], []
        for run in range(12):
            times = sorted(rng.randrange(0, rng.choice((1, 9, 60, 200))) for _ in range(rng.randrange(1, 25)))
            rows += [(f"r{run}", t) for t in times]
            expected += [(f"r{run}", *w) for w in literal_windows(times, width, stride, tail)]
        df = spark.createDataFrame(rows, "run_id string, ts_us long")
        got = windows.assign_windows(df, windows.WindowSpec(width, stride, tail)).groupBy("run_id", "w_idx", "pos").count().collect()
        assert sorted(tuple(r) for r in got) == sorted(expected)


def values(spark, rows, columns, expression):
    return [r[0] for r in spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], columns + ", _i int").orderBy("_i").select(expression).collect()]


@pytest.mark.parametrize(
    ("path", "protocol", "template"),
    [("/cart/12345?x=1", "http", "/cart/*"), ("/shop.Cart/AddItem", "grpc", "/*/additem"), ("/a/b/c/d/e/f", "http", "/a/b/c/d"), (None, "http", "/"), ("", None, "/"), ("plain", "http", "/"), ("/p/qz7h4kd92m/", "http", "/p/*/"),
     ("/x#frag", "http", "/x"), ("/a/deadbeef01/1f0e8c1a-0000-1111-2222-333344445555", "http", "/a/*/*"), ("/v1/a1b2c3", "grpc", "/v1/a1b2c3")],
)
def test_template_path(spark, path, protocol, template):
    assert values(spark, [(path, protocol)], "p string, q string", tokens.template_path(F.col("p"), F.col("q"))) == [template]


def test_names(spark):
    given = ["checkout-7c4d9b8f66-pq2rs", "relay-k8s4d", "plain-name", "mirror-2", "x1y2-a1b2", "a-b1c2-d3e4", "nohash"]
    assert values(spark, [(g,) for g in given], "n string", net.strip_pod_hash(F.col("n"))) == ["checkout", "relay", "plain-name", "mirror-2", "x1y2", "a", "nohash"]
    assert values(spark, [("svc.cluster.local",), ("A.b.Example.com..",), ("host",), ("",), (None,)], "n string", tokens.dns_token(F.col("n"))) == ["dst:cluster", "dst:ext:example.com", "dst:cluster", "dst:na", "dst:na"]
    assert values(spark, [(53,), (22,), (30000,), (60000,), (None,)], "n int", tokens.port_class(F.col("n"))) == ["dns", "system", "registered", "ephemeral", "na"]
    assert values(spark, [(0,), (204,), (None,)], "n int", tokens.status_class(F.col("n"))) == ["na", "2xx", "na"]
    assert values(spark, [("2025-01-01T00:00:01.5Z",), ("x",), (None,)], "n string", net.epoch_us(F.col("n"))) == [1735689601500000, None, None]
    assert values(spark, [("p:/a",), ("dst:ext:a.b",), (":x",)], "n string", tokens.unknown_token(F.col("n"))) == ["unk:p", "unk:dst-ext", "unk:misc"]


def test_sentences_cap_repeats_and_keep_names_out(spark):
    rows = [{"ts": float(i), "src_id": "a", "dst_id": "b", "method": "GET", "path": "/secret-a", "protocol": "http", "status_code": 200, "response_flags": "UF, DC"} for i in range(10)]
    rows += [{"ts": 3.5, "event_type": "DNS_QUERY", "src_id": "a", "dst_id": "dns:x.example.com", "dns_query": "x.example.com", "dns_qtypes": "A"}]
    placed = windows.assign_windows(events(spark, rows), windows.WindowSpec.seconds(100, 100, 1))
    got = {r.entity_id: r.sentence for r in sentences.sentences(placed).collect()}
    assert got["a"] == ["rpc:out", "proto:http", "m:get", "p:/secret-a", "st:2xx", "fl:uf", "fl:dc"] * 3 + ["dns:q", "qt:a", "dst:ext:example.com", "rc:na"]
    assert got["dns:x.example.com"] == ["dns:in", "qt:a", "rc:na"]
    short = {r.entity_id: r.sentence for r in sentences.sentences(placed, 3, 5).collect()}
    assert short["a"] == [got["a"][int(i * (25 / 5))] for i in range(5)]


def test_feature_layout(spark):
    spec = encoding.FeatureSpec(paths=["<oov>", "/a"], names=["<oov>", "example.com"])
    assert (spec.event_width, spec.entity_width) == (269, 17)
    assert list(spec.widths.values()) == [21, 101, 37, 51, 59]
    rows = [
        {"ts": 0.0, "src_id": "a", "dst_id": "b", "method": "GET", "path": "/a", "protocol": "http", "status_code": 404, "response_flags": "UF,weird,odd", "duration_ms": math.e - 1, "reporter_views": 2},
        {"ts": 1.0, "event_type": "L4_FLOW", "src_id": "a", "dst_id": "b", "l4_proto": "tcp", "dst_port": 22, "verdict": "POLICY_DENIED", "drop_reason": "policy_denied", "is_reply": True},
        {"ts": 2.0, "event_type": "DNS_QUERY", "src_id": "a", "dst_id": "b", "dns_query": "x.example.com", "dns_rcode": "3"},
        {"ts": 3.0, "event_type": "K8S_API_CALL", "src_id": "a", "dst_id": "b", "k8s_verb": "list", "k8s_resource": "pods", "k8s_subresource": "exec", "k8s_user_type": "sa", "k8s_status_code": 200},
    ]
    df = events(spark, rows)
    vector = lambda strip=False: [r[0] for r in df.orderBy("ord").select(encoding.event_features(spec, F.lit(0), F.lit(0.25), strip)).collect()]
    full = vector()
    assert all(len(v) == 269 for v in full)
    rpc, flow, dns, api = ({i for i, x in enumerate(v) if x} for v in full)
    shared = {*range(5, 20, 2), 20}  # cosines of position 0, relative time
    assert rpc == shared | {0, 21, 24, 21 + 3 + 10 + 1, 98 + 4, 104, 107 + 1, 107 + 10, 118, 121}
    assert full[0][118] == pytest.approx(1.0) and full[0][20] == 0.25
    assert flow == shared | {1, 122, 126 + encoding.PORTS.index("system"), 147 + 4, 153 + 1, 156}
    assert dns == shared | {2, 159 + 9, 169 + 1, 172 + 1, 204 + 1}
    assert api == shared | {3, 210 + 1, 220, 252 + 2, 259, 263 + 2}
    assert {i for i, x in enumerate(vector(True)[1]) if x} == flow - {151, 154}


def test_memory_graph_edges(spark):
    rows = [{"ts": t, "src_id": "a", "dst_id": "b"} for t in (0.0, 1.0, 20.0, 23.0)]
    placed = windows.assign_windows(events(spark, rows), windows.WindowSpec.seconds(5, 5, 2.5))
    nodes = memory.event_nodes(placed, 5_000_000)
    copies = memory.entity_copies(memory.incidence(nodes, pods(spark, "a", "b")))
    assert sorted((r.entity_id, r.pos) for r in copies.collect()) == [("a", 0), ("a", 4), ("b", 0), ("b", 4)]
    assert sorted((r.entity_id, r.pos, r.later) for r in memory.recurrence_edges(copies, 5).collect()) == [("a", 0, 4), ("b", 0, 4)]
    assert memory.recurrence_edges(copies, 4).count() == 0
    assert memory.spatial_edges(memory.incidence(nodes, pods(spark, "a", "b"))).groupBy("edge_type").count().collect() and memory.spatial_edges(memory.incidence(nodes, pods(spark, "a", "b"))).count() == 16


def test_chains_are_capped_and_names_do_not_answer(spark):
    rows = [{"ts": i / 10, "src_id": "a", "dst_id": "b"} for i in range(25)] + [{"ts": 3.0, "event_type": "DNS_QUERY", "src_id": "a", "dst_id": "n"}]
    placed = windows.assign_windows(events(spark, rows), windows.WindowSpec.seconds(50, 50, 1))
    nodes = memory.event_nodes(placed, 50_000_000)
    follow = {r.edge_type: r["count"] for r in memory.follow_edges(nodes, 20).groupBy("edge_type").count().collect()}
    assert follow == {"follows_src": sum(min(i, 20) for i in range(26)), "follows_dst": sum(min(i, 20) for i in range(25))}
    kinds = {r.edge_type: r["count"] for r in memory.spatial_edges(memory.incidence(nodes, pods(spark, "a", "b", "n"))).groupBy("edge_type").count().collect()}
    assert kinds == {"src_of": 26, "rev_src_of": 26, "dst_of": 26, "rev_dst_of": 25}


def test_event_cap_keeps_dropped_flows(spark):
    rows = [{"ts": float(i), "src_id": "a", "dst_id": "b"} for i in range(30)] + [{"ts": 4.5, "event_type": "L4_FLOW", "src_id": "a", "dst_id": "b", "verdict": "DROPPED"}]
    placed = windows.assign_windows(events(spark, rows), windows.WindowSpec.seconds(100, 100, 1))
    kept = memory.cap_events(placed, 10).collect()
    times = sorted(int(r.ts) for r in kept if r.event_type == "RPC_CALL")
    assert len(kept) == 10 and [r.event_type for r in kept].count("L4_FLOW") == 1
    assert times == sorted({int(i * (29 / 8)) for i in range(8)} | {29})
    assert memory.cap_events(placed, 1).count() == 1 and memory.cap_events(placed, 31).count() == 31


def test_quantiles_ranks_and_area(spark):
    rng = random.Random(3)
    data = [(g, float(rng.choice((rng.randrange(5), rng.random() * 50)))) for g in "xyz" for _ in range(rng.randrange(1, 400))]
    df = spark.createDataFrame(data, "node_type string, score_raw double")
    for q in (0.0, 0.3, 0.995, 1.0):
        got = {r.node_type: r.threshold for r in alerts.quantile_thresholds(df, q).collect()}
        for g in "xyz":
            v = sorted(x for k, x in data if k == g)
            at = (len(v) - 1) * q
            assert got[g] == pytest.approx(v[math.floor(at)] + (v[math.ceil(at)] - v[math.floor(at)]) * (at - math.floor(at)))
    probes = spark.createDataFrame([("x", -1.0), ("x", 2.0), ("x", 99.0), ("w", 0.7)], "node_type string, score_raw double")
    own = sorted(x for k, x in data if k == "x")
    expected = {v: (sum(x < v for x in own) + sum(x <= v for x in own)) / (2 * len(own)) for v in (-1.0, 2.0, 99.0)} | {0.7: 0.7}
    assert {r.score_raw: r.score_norm for r in alerts.normalised(probes, df).collect()} == pytest.approx(expected)

    def area(pos, neg):
        rows = [(x, True) for x in pos] + [(x, False) for x in neg]
        r = stats.auc(spark.createDataFrame(rows, "v double, p boolean"), "v", F.col("p")).first()
        return r.auc

    assert (area([3.0, 4.0], [1.0, 2.0]), area([1.0], [2.0]), area([1.0, 1.0], [1.0]), area([1.0], [])) == (1.0, 0.0, 0.5, None)


def test_split_sizes(spark):
    for n, part, expected in ((1, 0.2, (1, 0, 0)), (2, 0.2, (1, 1, 0)), (3, 0.2, (1, 1, 1)), (5, 0.5, (1, 2, 2)), (10, 0.2, (6, 2, 2))):
        runs = spark.createDataFrame([(f"b-x_{i:03d}",) for i in range(n)], "run_id string")
        got = [r.split for r in splits.temporal_split(runs, part, part).orderBy("place").collect()]
        assert tuple(got.count(s) for s in ("train", "val", "test")) == expected
        assert got == sorted(got, key=("train", "val", "test").index)


def test_alerts(spark):
    rows = [("r", w, "p", "Pod", "web", "web", 0.0, s, s) for w, s in enumerate((0.2, 0.9, 0.4, 0.8))] + [("r", 0, "s", "Service", "web", "web", 0.0, 1.0, 1.0)]
    scores = spark.createDataFrame(rows, "run_id string, w_idx long, entity_id string, node_type string, true_label string, pred_label string, p_true double, score_raw double, score_norm double")
    with_limits = alerts.apply_thresholds(scores, spark.createDataFrame([("Pod", 0.85)], "node_type string, threshold double"))
    (alert,) = alerts.pod_alerts(with_limits).collect()
    assert (alert.windows, alert.max_score, alert.is_alert, alert.threshold) == (4, 0.9, True, 0.85) and alert.top3_mean == pytest.approx(0.7)
    assert alerts.pod_alerts(with_limits.where("node_type = 'Service'")).count() == 0
    assert {r.node_type: r.threshold for r in with_limits.collect()} == {"Pod": 0.85, "Service": 1.0}


def test_perturbations(spark):
    rows = [{"ts": 1.0, "src_id": "pod:default/a", "dst_id": "svc:default/x"}, {"ts": 2.0, "src_id": "pod:default/b", "dst_id": "svc:default/y"}]
    df = events(spark, rows)
    ents = spark.createDataFrame([("r", s, "Service") for s in ("svc:default/x", "svc:default/y")], "run_id string, entity_id string, entity_type string")
    for name, mutate in perturb.PERTURBATIONS.items():
        changed, victims = mutate(df, ents)
        (victim,) = (r.victim for r in victims.collect())
        out = changed.orderBy("ts_us", "ord").collect()
        if name == "dns_exfil":
            new = [r for r in out if r.event_type == "DNS_QUERY"]
            assert len(new) == 20 and {r.src_id for r in new} == {victim} and new[1].ts_us - new[0].ts_us == 100_000
        elif name == "api_burst":
            assert [r.k8s_resource for r in out if r.event_type == "K8S_API_CALL"][:4] == ["secrets", "pods", "secrets", "pods"]
        elif name == "sentence_swap":
            assert [r.src_id for r in out] == ["pod:default/b", "pod:default/a"]
        else:
            assert {r.dst_id for r in out if r.src_id == victim} == {"svc:default/y" if victim.endswith("a") else "svc:default/x"}


def test_config():
    own = config.load(None, ["detector=ppt", "detectors.ppt.windows.width_s=10", "data.benchmarks=[a, b]"])
    seen = config.view(own)
    assert config.get(seen, "windows.width_s") == 10 and config.get(seen, "windows.stride_s") == 5 and config.get(seen, "data.benchmarks") == ["a", "b"]
    assert config.get(own, "windows.width_s") == 30 and config.get(seen, "no.such", 7) == 7
    assert config.get(config.view(config.load()), "windows.width_s") == 30
    with pytest.raises(ValueError, match="key=value"):
        config.load(None, ["oops"])


def test_shuffle_partitions_grow_with_a_table(spark, tmp_path, monkeypatch):
    from weftlog import scratch

    spark.range(1000).write.parquet(f"{tmp_path}/t")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(scratch, "BYTES", 500)
    try:
        scratch.roomy(spark, f"{tmp_path}/t")
        grown = int(spark.conf.get("spark.sql.shuffle.partitions"))
        monkeypatch.setattr(scratch, "BYTES", 1 << 30)
        scratch.roomy(spark, f"{tmp_path}/t")
        assert grown > int(was) and int(spark.conf.get("spark.sql.shuffle.partitions")) == grown
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_cap_over_several_slots(spark, monkeypatch):
    """Slots of time are ordered apart, and the same events are kept."""
    from weftlog.operators import memory

    rows = [("r", 0, i * 7 % 101 * 1_000_000, 0, i, "RPC_CALL", None) for i in range(101)]
    placed = spark.createDataFrame(rows, "run_id string, pos long, ts_us long, t0_us long, ord long, event_type string, verdict string")
    kept = lambda: sorted(r.ts_us for r in memory.cap_events(placed, 11).collect())
    monkeypatch.setattr(memory, "SLOT", 9_000_000)
    assert kept() == [i * 10_000_000 for i in range(11)]


def test_vectors_looked_up_by_destination(spark):
    """Means of neighbours are the same where features hold only the number of a vector."""
    from weftlog.operators import graphs

    edges = spark.createDataFrame([("r", "a", "c"), ("r", "b", "c"), ("r", "a", "b")], "run_id string, src string, dst string")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0])], "vec_id long, x array<double>")
    nodes = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "run_id string, entity_id string, vec_id long")
    out = graphs.neighbour_mean(edges, nodes, ["run_id"], vectors=vectors)
    assert {r.entity_id: r.x for r in out.collect()} == {"c": [2.0, 4.0], "b": [1.0, 2.0]}


def test_vectors_are_added_up_as_columns(spark, monkeypatch):
    """Means by columns are the summarizer's, and hops hear the means of the hop before."""
    from weftlog.operators import graphs

    edges = spark.createDataFrame([("r", 0, "a", "c"), ("r", 0, "b", "c"), ("r", 0, "a", "b"), ("r", 1, "b", "c")], "run_id string, w_idx long, src string, dst string")
    nodes = spark.createDataFrame([("r", 0, "a", [1.0, 2.0]), ("r", 0, "b", [3.0, 6.0]), ("r", 0, "c", [5.0, 5.0]), ("r", 1, "c", [7.0, 7.0])], "run_id string, w_idx long, entity_id string, x array<double>")
    expected = {(0, "a"): ([0.0, 0.0], [0.0, 0.0]), (0, "b"): ([1.0, 2.0], [0.0, 0.0]), (0, "c"): ([2.0, 4.0], [0.5, 1.0]), (1, "c"): ([0.0, 0.0], [0.0, 0.0])}
    for most in (90, 1):
        monkeypatch.setattr(graphs, "COLUMNS", most)
        out = graphs.propagated(edges, nodes, ["run_id", "w_idx"], 2, width=2)
        assert out.columns == ["run_id", "w_idx", "entity_id", "x", "x1", "x2"]
        assert {(r.w_idx, r.entity_id): (r.x1, r.x2) for r in out.collect()} == expected
        plan = graphs.mean_vectors(nodes, ["run_id"], "x", 2)._jdf.queryExecution().executedPlan().toString()
        assert ("ObjectHashAggregate" in plan) == (most == 1)


def test_views_are_shuffled_once_for_sentences(spark):
    from weftlog.operators import sentences

    rows = spark.createDataFrame([("r", 0, 0, 1, 1, 0, "e", ["a", "b"])], "run_id string, w_idx long, pos long, ts_us long, ord long, seq int, entity_id string, tokens array<string>")
    kept = sentences.capped_views(rows, 3).groupBy("run_id", "w_idx", "pos", "entity_id").agg(F.collect_list("tokens").alias("t"))
    assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_only_sentences_with_rare_tokens_are_taken_apart(spark, monkeypatch):
    from weftlog.operators import models

    tables, own = {}, models.written
    monkeypatch.setattr(models, "written", lambda df, name: tables.setdefault(name, own(df, name)))
    said = spark.createDataFrame([("r", 0, "a", ["p:x", "p:y", "p:x"]), ("r", 0, "b", ["p:y", "dst:ext:one", "p:x"]), ("r", 1, "a", []), ("r", 1, "b", ["q", "p:y"])], "run_id string, w_idx long, entity_id string, sentence array<string>")
    found = {(r.w_idx, r.entity_id): r.sentence for r in models.with_unknowns(said).collect()}
    assert found == {(0, "a"): ["p:x", "p:y", "p:x"], (0, "b"): ["p:y", "unk:dst-ext", "p:x"], (1, "b"): ["unk:q", "p:y"]}
    assert {(r.w_idx, r.entity_id) for r in tables["sentences-with-rare"].collect()} == {(0, "b"), (1, "b")}
