import pytest
from pyspark.sql import functions as F

from weftlog.schema import BEHAVIOUR, EVENTS
from weftlog.sources import runs
from weftlog.sources.files import numbered_lines

RUN = "boutique-mix_20250304-090000"


@pytest.fixture(scope="module")
def tables(spark, ingested):
    events, entities = runs.load(spark, ingested, [RUN])
    return {r.event_id: r for r in events.collect()}, {r.entity_id: r for r in entities.collect()}


def by_type(events, kind):
    return sorted((e for e in events.values() if e.event_type == kind), key=lambda e: (e.ts, e.ord))


WEB, BASKET = "pod:default/web-5b8f7c9d44-kx2lp", "pod:default/basket-7d9c8b6f55-q8z4m"


def test_counts(tables):
    events, _ = tables
    assert {k: len(by_type(events, k)) for k in ("RPC_CALL", "L4_FLOW", "DNS_QUERY", "K8S_API_CALL")} == {"RPC_CALL": 4, "L4_FLOW": 3, "DNS_QUERY": 1, "K8S_API_CALL": 1}


def test_a_pair_of_views_is_one_call_as_the_server_saw_it(tables):
    call = next(e for e in by_type(tables[0], "RPC_CALL") if e.reporter_views == 2)
    assert (call.src_id, call.dst_id, call.dst_svc_id) == (WEB, BASKET, "svc:default/basket")
    assert call.event_id == f"{RUN}:istio/access_logs/basket-7d9c8b6f55-q8z4m.log:1"
    assert (call.protocol, call.grpc_status, call.status_code, call.request_bytes) == ("grpc", 0, 200, 11)


def test_single_views(tables):
    calls = {e.event_id.rpartition(":")[2]: e for e in by_type(tables[0], "RPC_CALL") if "web-" in e.event_id}
    assert (calls["4"].src_id, calls["4"].dst_id, calls["4"].grpc_status) == ("pod:default/late-6f5d4c3b2a-zz9yx", WEB, None)
    text = calls["5"]
    assert (text.src_id, text.method, text.path, text.status_code, text.response_flags, text.duration_ms) == ("ext:host", "GET", "/plain", 503, "UF,URX", 3.0)
    again = calls["6"]  # a second outbound view of one request stands alone
    assert (again.src_id, again.dst_id, again.dst_type, again.reporter_views) == (WEB, "svc:default/basket", "Service", 1)


def test_flows_and_names(tables):
    flows = by_type(tables[0], "L4_FLOW")
    assert [(f.dst_port, f.verdict, f.drop_reason, f.l4_proto) for f in flows] == [(7070, "FORWARDED", None, "tcp"), (9999, "DROPPED", "POLICY_DENIED", "tcp"), (53, "FORWARDED", None, "udp")]
    assert [f.dst_id for f in flows] == [BASKET, "ext:world", "svc:default/web"]
    (name,) = by_type(tables[0], "DNS_QUERY")
    assert (name.src_id, name.dst_id, name.dns_qtypes, name.dns_rcode) == (WEB, "dns:api.example.com", "A,AAAA", "3")


def test_audit(tables):
    (call,) = by_type(tables[0], "K8S_API_CALL")
    assert (call.src_id, call.dst_id, call.k8s_verb, call.k8s_user_type) == (WEB, "kubeapi:cluster", "list", "sa")


def test_entities(tables):
    _, entities = tables
    assert entities[WEB].canonical_service == "web" and entities[WEB].workload == "web" and entities[WEB].has_sidecar
    assert entities[BASKET].canonical_service == "basket" and entities[BASKET].workload == "basket-7d9c8b6f55"
    assert entities["pod:other/gone-abc12"].canonical_service == "gone"
    assert entities["pod:default/loader"].has_sidecar is False
    # named by dropped events only, or by none
    assert {"ext:host", "ext:world", "kubeapi:cluster", "svc:default/web", "dns:api.example.com"} <= set(entities)
    assert "dns:skipped.example" not in entities


def test_unfinished_runs_are_skipped(spark, ingested):
    assert [r[-6:] for r in runs.list_runs(spark, ingested)] == ["090000", "100000", "110000"]
    assert runs.list_runs(spark, ingested, ["other"]) == []


def test_order_of_ties_is_the_order_of_ingest(tables):
    assert all(e.ord == 1 for e in tables[0].values())


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "r" / "cilium").mkdir(parents=True)
    (tmp_path / "r" / "cilium" / "flows.jsonl").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.minPartitionNum", "7")
    try:
        rows = numbered_lines(spark, f"{tmp_path}/*", "cilium/flows.jsonl")
        assert rows.where(F.col("line") != F.concat(F.lit("line "), "lineno")).count() == 0
        assert rows.count() == 5000 and rows.select("file").distinct().collect()[0][0] == "cilium/flows.jsonl"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_line_numbers_do_not_depend_on_later_splits(spark, tmp_path):
    (tmp_path / "r" / "cilium").mkdir(parents=True)
    (tmp_path / "r" / "cilium" / "flows.jsonl").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    settings = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.minPartitionNum": "7"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = numbered_lines(spark, f"{tmp_path}/*", "cilium/flows.jsonl")
        for name in settings:
            spark.conf.set(name, "64") if name.endswith("Num") else spark.conf.set(name, "1024")
        assert rows.where(F.col("line") == F.concat(F.lit("line "), "lineno")).count() == 5000
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_ingest_by_byte_ranges_gives_the_same_tables(spark, run_root):
    for plain, pruned in zip(runs.ingest(spark, f"{run_root}/*", ["boutique"]), runs.ingest(spark, f"{run_root}/*", ["boutique"], pruned=True), strict=True):
        assert plain.count() > 0 and sorted(map(repr, plain.collect())) == sorted(map(repr, pruned.collect()))


def test_missing_sources_are_empty(spark, tmp_path):
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "meta.json").write_text('{"benchmark": "b", "request": "r", "run_id": "1", "run_status": 0}')
    events, entities = runs.ingest(spark, f"{tmp_path}/*")
    assert events.count() == 0 and [r.entity_id for r in entities.collect()] == ["kubeapi:cluster"]


def test_no_endpoint_among_what_tokens_may_see():
    assert not {c for c in BEHAVIOUR if c.endswith("_id") or c in ("src_type", "dst_type")}
    assert set(BEHAVIOUR) <= {f.name for f in EVENTS}


def test_paired_view_with_large_part_numbers(spark, tmp_path):
    """Numbers of parts that run into the item's number, as in larger tables, leave the order of items alone."""
    import duckdb

    from weftlog.plans import catalog

    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT * REPLACE ((l_partkey * 7919 + l_linenumber * 104729) % 200000 AS l_partkey) FROM '/root/testdata/sf0.001/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    duck.execute(f"COPY (FROM '/root/testdata/sf0.001/orders.parquet') TO '{tmp_path}/orders.parquet'")
    for name in ("lineitem", "orders"):
        duck.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    found = duck.execute(catalog.ORACLES["access_log_events"])
    order = [d[0] for d in found.description]
    rows = catalog.QUERIES["access_log_events"](spark, str(tmp_path)).select(*order).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(found.fetchall(), key=repr)


def optimized(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_paths_are_read_by_split_and_not_by_line(spark, run_root):
    rows = numbered_lines(spark, f"{run_root}/*", runs.LOGS)
    assert "regexp" not in optimized(rows)
    own = runs.run_catalogue(spark, f"{run_root}/*", ["boutique"]).select("run_dir", "run_id")
    kept = numbered_lines(spark, f"{run_root}/*", runs.LOGS, own)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, rows.join(own, "run_dir").select(*kept.columns).collect()))
    assert kept.select("run_id").distinct().count() == 3  # the unfinished run is left out


def test_audit_records_are_parsed_once(spark):
    from weftlog.sources import audit

    lines = spark.range(1).selectExpr("'r' AS run_id", "'a' AS file", "id AS lineno", "cast(id AS string) AS line")
    addresses = spark.createDataFrame([], "run_id string, ip string, entity_id string, entity_type string")
    assert optimized(audit.api_events(lines, addresses)).count("from_json(") == 1


def test_views_meet_in_one_window(spark):
    from weftlog.sources import access

    views = spark.createDataFrame([("r", "a", "inbound", 1), ("r", "a", "inbound", 2), ("r", "a", "outbound", 3), ("r", "a", "outbound", 4), ("r", "b", "inbound", 5), ("r", None, "inbound", 6), ("r", "c", "unknown", 7)], "run_id string, request_id string, direction string, seen int")
    rows = access.merged_views(views, [])
    assert optimized(rows).count("Window [") == 1
    found = {(r.outbound and r.outbound.seen, r.inbound and r.inbound.seen, r.turn, r.reporter_views) for r in rows.collect()}
    assert found == {(3, 1, 0, 2), (None, 2, 2, 1), (4, None, 2, 1), (None, 5, 1, 1), (None, 6, 2, 1), (7, None, 2, 1)}


def test_entities_without_events_are_the_same(spark, run_root):
    both, alone = runs.ingest(spark, f"{run_root}/*", ["boutique"])[1], runs.ingest_entities(spark, f"{run_root}/*", ["boutique"])
    assert sorted(map(repr, both.collect())) == sorted(map(repr, alone.collect()))


def test_events_without_entities_are_the_same_and_not_written_first(spark, run_root, monkeypatch):
    names, own = [], runs.written
    both = runs.ingest(spark, f"{run_root}/*", ["boutique"])[0]
    monkeypatch.setattr(runs, "written", lambda df, name: names.append(name) or own(df, name))
    alone = runs.ingest_events(spark, f"{run_root}/*", ["boutique"])
    assert sorted(map(repr, both.collect())) == sorted(map(repr, alone.collect())) and "parsed" not in names
