"""Queries on ingest joins, selection rules and perturbations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlog.operators import perturb
from weftlog.plans.registry import query, table
from weftlog.plans.testdata import TEL, entities, telemetry
from weftlog.sources import access, flows, snapshot


@query(TEL + " SELECT event_id, coalesce(verdict <> 'FORWARDED', true) OR (l4_proto = 'tcp' AND k % 2 = 0 AND k % 4 <> 0) OR (l4_proto IN ('udp', 'icmp') AND k % 5 <> 0) AS kept FROM tel WHERE event_type = 'L4_FLOW'")
def l4_keep_rules(spark, sf_dir):
    """Which flows to keep."""
    k = F.get_json_object("props", "$.k").cast("int")
    extra = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), k.alias("k"))
    rows = telemetry(spark, sf_dir).where("event_type = 'L4_FLOW'").join(extra, "event_id")
    keep = flows.keep(F.col("verdict"), F.col("l4_proto"), F.col("k") % 2 == 0, F.col("k") % 4 == 0, F.col("k") % 5 == 0, ("non_forwarded", "syn_no_ack", "udp_first"))
    return rows.select("event_id", keep.alias("kept"))


@query(
    """WITH v AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'i' ELSE '' END || l_orderkey AS rid, 'inbound' AS direction, l_linenumber AS ord, 'l' || l_suppkey AS reporter FROM lineitem
      UNION ALL SELECT CASE WHEN o_orderkey % 2 = 1 THEN 'o' ELSE '' END || o_orderkey, 'outbound', 0, 'o' || o_custkey FROM orders),
    f AS (SELECT *, row_number() OVER (PARTITION BY rid, direction ORDER BY ord, reporter) AS nth FROM v),
    o AS (SELECT * FROM f WHERE direction = 'outbound' AND nth = 1), i AS (SELECT * FROM f WHERE direction = 'inbound' AND nth = 1)
    SELECT coalesce(i.rid, o.rid) AS request_id, o.reporter AS client, i.reporter AS server, (CASE WHEN i.rid IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN o.rid IS NOT NULL THEN 1 ELSE 0 END)::INTEGER AS reporter_views FROM o FULL OUTER JOIN i ON i.rid = o.rid
    UNION ALL SELECT rid, CASE WHEN direction = 'outbound' THEN reporter END, CASE WHEN direction = 'inbound' THEN reporter END, 1 FROM f WHERE nth > 1"""
)
def view_merge_full_outer(spark, sf_dir):
    """Two views of one request become one (J01, J02, W05, U07); some requests are seen by one side only."""
    own = lambda key, alone, mark: F.concat(F.when(F.expr(alone), mark).otherwise(""), F.col(key).cast("string")).alias("request_id")
    inbound = table(spark, sf_dir, "lineitem").select(F.lit("r").alias("run_id"), own("l_orderkey", "l_orderkey % 3 = 0", "i"), F.lit("inbound").alias("direction"), F.struct(F.col("l_linenumber").cast("long"), F.concat(F.lit("l"), "l_suppkey")).alias("seen"), F.concat(F.lit("l"), "l_suppkey").alias("reporter"))
    outbound = table(spark, sf_dir, "orders").select(F.lit("r").alias("run_id"), own("o_orderkey", "o_orderkey % 2 = 1", "o"), F.lit("outbound").alias("direction"), F.struct(F.lit(0).cast("long"), F.concat(F.lit("o"), "o_custkey")).alias("seen"), F.concat(F.lit("o"), "o_custkey").alias("reporter"))
    merged = access.merged_views(inbound.union(outbound), ["reporter"], order="seen")
    client, server = F.col("outbound.reporter"), F.col("inbound.reporter")
    return merged.select("request_id", client.alias("client"), server.alias("server"), "reporter_views")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 100 < 30 THEN 'pod:default/p' || (c_custkey % 100) WHEN c_custkey % 100 < 60 THEN 'svc:default/s' || (c_custkey % 100) WHEN c_custkey % 100 < 80 THEN 'ext:host' ELSE 'ext:world' END AS entity_id FROM customer"""
)
def ip_resolution_priority(spark, sf_dir):
    """Addresses by pod, service, node and the rest."""
    ips = spark.range(80).select(F.lit("r").alias("run_id"), F.concat(F.lit("10.0.0."), "id").alias("ip"), "id")
    own = lambda kind, what, rank, cond: ips.where(cond).select("run_id", "ip", F.concat(F.lit(what), "id").alias("entity_id"), F.lit(kind).alias("entity_type"), F.lit(rank).alias("rank"))
    nodes = ips.select("run_id", "ip", F.lit("ext:host").alias("entity_id"), F.lit("ExternalEndpoint").alias("entity_type"), F.lit(2).alias("rank"))
    table_ = snapshot.first_by_rank(own("Pod", "pod:default/p", 0, "id < 30").union(own("Service", "svc:default/s", 1, "id < 60")).union(nodes))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("r").alias("run_id"), F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("10.0.0."), F.col("c_custkey") % 100)).otherwise("").alias("ip"))
    return snapshot.resolve_ip(rows, table_, "ip", "entity").select("c_custkey", F.col("entity_id"))


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'deploy' || n.n_regionkey ELSE 'rs' || c_nationkey END AS workload FROM customer JOIN nation n ON n_nationkey = c_nationkey"""
)
def owner_chain(spark, sf_dir):
    """Replica sets to deployments."""
    owners = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.lit("r").alias("run_id"), F.concat(F.lit("rs"), "n_nationkey").alias("owner"), F.concat(F.lit("deploy"), "n_regionkey").alias("deployment"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("r").alias("run_id"), F.concat(F.lit("rs"), "c_nationkey").alias("owner"))
    return snapshot.with_workload(rows, owners).select("c_custkey", "workload")


VICTIM = TEL + ", v AS (SELECT run_id, min(src_id) AS victim FROM tel WHERE src_type = 'Pod' GROUP BY 1)"


def _victims(events):
    return perturb.pods_in(events).groupBy("run_id").agg(F.min("pod").alias("victim"))


_COLS = "run_id, event_id, event_type, src_id, dst_id, ts_us"


@query(VICTIM + f" SELECT {_COLS} FROM tel UNION ALL SELECT v.run_id, 'perturb:dns:' || i, 'DNS_QUERY', victim, 'dns:{perturb.EXFIL_DOMAIN}', t0 + i * 100000 FROM (SELECT v.run_id, victim, min(ts_us) AS t0 FROM v JOIN tel ON tel.run_id = v.run_id AND src_id = victim GROUP BY ALL) v, (SELECT unnest(range({perturb.EXFIL_QUERIES})) AS i)")
def perturb_dns_exfil(spark, sf_dir):
    """Injected name queries."""
    events = telemetry(spark, sf_dir)
    return perturb.dns_exfil(events, None, victims=_victims(events))[0].select(*_COLS.split(", "))


@query(
    VICTIM
    + f""", q AS (SELECT run_id, min(src_id) AS victim FROM tel WHERE src_type = 'Pod' AND (run_id, src_id) NOT IN (SELECT run_id, src_id FROM tel WHERE event_type = 'K8S_API_CALL') GROUP BY 1)
    SELECT {_COLS}, k8s_verb, k8s_resource FROM tel UNION ALL
    SELECT b.run_id, 'perturb:api:' || i, 'K8S_API_CALL', victim, 'kubeapi:cluster', t0 + i * 100000, ['list', 'create', 'get', 'create'][i % 4 + 1], ['secrets', 'pods', 'secrets', 'pods'][i % 4 + 1]
    FROM (SELECT q.run_id, victim, min(ts_us) AS t0 FROM q JOIN tel ON tel.run_id = q.run_id AND src_id = victim GROUP BY ALL) b, (SELECT unnest(range({perturb.BURST_CALLS})) AS i)"""
)
def perturb_api_burst(spark, sf_dir):
    """Injected API calls from a quiet pod."""
    events = telemetry(spark, sf_dir)
    victims = perturb.quiet_pods(events).groupBy("run_id").agg(F.min("pod").alias("victim"))
    return perturb.api_burst(events, None, victims=victims)[0].select(*_COLS.split(", "), "k8s_verb", "k8s_resource")


_UNCALLED = VICTIM + ", u AS (SELECT e.run_id, entity_id AS service FROM ent e JOIN v USING (run_id) WHERE entity_type = 'Service' AND (e.run_id, entity_id) NOT IN (SELECT tel.run_id, dst_id FROM tel JOIN v ON tel.run_id = v.run_id AND src_id = victim WHERE event_type = 'RPC_CALL'))"


@query(_UNCALLED + " SELECT run_id, service FROM u")
def services_never_called(spark, sf_dir):
    """Services that a victim never calls by their own id."""
    events = telemetry(spark, sf_dir)
    return perturb.services_not_called(events, entities(events), _victims(events))


@query(_UNCALLED + ", t AS (SELECT run_id, min(service) AS target FROM u GROUP BY 1) SELECT tel.run_id, event_id, src_id, CASE WHEN event_type = 'RPC_CALL' AND src_id = victim AND target IS NOT NULL THEN target ELSE dst_id END AS dst_id, CASE WHEN event_type = 'RPC_CALL' AND src_id = victim AND target IS NOT NULL THEN target ELSE dst_svc_id END AS dst_svc_id FROM tel LEFT JOIN v ON v.run_id = tel.run_id LEFT JOIN t ON t.run_id = tel.run_id")
def perturb_rewire(spark, sf_dir):
    """A victim's calls go elsewhere."""
    events = telemetry(spark, sf_dir)
    victims = _victims(events)
    targets = perturb.services_not_called(events, entities(events), victims).groupBy("run_id").agg(F.min("service").alias("target"))
    return perturb.retargeted(events, victims.join(targets, "run_id", "left")).select("run_id", "event_id", "src_id", "dst_id", "dst_svc_id")


@query(VICTIM + ", o AS (SELECT run_id, max(src_id) AS other FROM tel GROUP BY 1) SELECT tel.run_id, event_id, CASE src_id WHEN victim THEN other WHEN other THEN victim ELSE src_id END AS src_id FROM tel JOIN v ON v.run_id = tel.run_id JOIN o ON o.run_id = tel.run_id")
def perturb_swap(spark, sf_dir):
    """Two sources change places."""
    events = telemetry(spark, sf_dir)
    pairs = perturb.pods_in(events).groupBy("run_id").agg(F.min("pod").alias("victim"), F.max("pod").alias("other"))
    return perturb.swapped(events, pairs).select("run_id", "event_id", "src_id")


@query(TEL + " SELECT run_id, event_id, method, CAST(NULL AS VARCHAR) AS verdict FROM tel WHERE event_type = 'RPC_CALL' UNION ALL SELECT run_id, event_id, NULL, verdict FROM tel WHERE event_type = 'L4_FLOW'")
def union_missing_columns(spark, sf_dir):
    """Unions of tables with different columns."""
    events = telemetry(spark, sf_dir)
    calls = events.where("event_type = 'RPC_CALL'").select("run_id", "event_id", "method")
    return calls.unionByName(events.where("event_type = 'L4_FLOW'").select("run_id", "event_id", "verdict"), allowMissingColumns=True)
