"""Queries on feature vectors of events and entities, and on records of scored nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlog.functions import encoding
from weftlog.operators import graphs, links, memory, models, stats, windows
from weftlog.plans.graph_queries import CAPPED, INCIDENT, MEMORY, NODES, _incident, _nodes
from weftlog.plans.link_queries import _hash
from weftlog.plans.registry import placed, query
from weftlog.plans.testdata import entities, telemetry
from weftlog.plans.token_queries import _PORT_CASE, fill
from weftlog.scratch import written
from weftlog.schema import API, L4, RPC

#: A layout with vocabularies that lack some of what occurs, and scalers.
SPEC = encoding.FeatureSpec(
    paths=[encoding.OOV, "/cart", "/item/*/view"], names=[encoding.OOV, "example1.com", "example3.com"], resources=[encoding.OOV, "pods", "secrets"],
    scalers={"duration_ms": (3.0, 0.5), "request_bytes": (5.0, 1.5), "response_bytes": (8.0, 0.25)},
)


def _list(names) -> str:
    return "['" + "', '".join(names) + "']"


def _at(value: str, names, offset: int) -> str:
    return f"{offset} + list_position({_list(names)}, {value}) - 1"


def _known(value: str, names, offset: int) -> str:
    return f"{offset} + greatest(coalesce(list_position({_list(names)}, {value}), 0) - 1, 0)"


_SCALED = "greatest(-5.0::DOUBLE, least(5.0::DOUBLE, (ln(1 + greatest({v}, 0)) - {m}::DOUBLE) / {d}::DOUBLE))"
_STATUS = "CASE status_code WHEN 500 THEN 5 WHEN 404 THEN 4 ELSE 2 END"
#: Places of the blocks and fields within 269: 0 shared, 21 calls, 122 flows, 159 names, 210 API calls.
ENTRIES = (
    CAPPED
    + f""", hot AS (
  SELECT run_id, pos, event_id, unnest(list_concat([CASE event_type WHEN 'RPC_CALL' THEN 0 WHEN 'L4_FLOW' THEN 1 WHEN 'DNS_QUERY' THEN 2 ELSE 3 END], CASE event_type
    WHEN 'RPC_CALL' THEN list_concat([21, CASE method WHEN 'GET' THEN 24 ELSE 25 END, 36, 98 + {_STATUS}, 104 + ord % 3], CASE ord % 3 WHEN 0 THEN [108, 111] WHEN 1 THEN [108, 117] ELSE [] END)
    WHEN 'L4_FLOW' THEN [{_at('l4_proto', encoding.L4_PROTOCOLS, 122)}, {_at('(' + fill(_PORT_CASE, p='dst_port') + ')', encoding.PORTS, 126)}, CASE verdict WHEN 'FORWARDED' THEN 147 WHEN 'DROPPED' THEN 148 ELSE 151 END, 153 + ord % 3, 156 + ord % 3]
    WHEN 'DNS_QUERY' THEN [159, 170, {_known("'example' || (k % 5) || '.com'", SPEC.names, 172)}, 204 + CASE WHEN dns_rcode IS NULL THEN 5 WHEN dns_rcode = '0' THEN 0 ELSE 1 END]
    ELSE [{_at('k8s_verb', encoding.VERBS, 210)}, {_known('k8s_resource', SPEC.resources, 220)}, 252 + [0, 2, 6][ord % 3 + 1], 259, 265] END)) AS i, 1.0::DOUBLE AS v FROM evs),
wide AS (
  SELECT * FROM hot
  UNION ALL SELECT run_id, pos, event_id, 4 + d, CASE WHEN d % 2 = 0 THEN sin(o / pow(10000.0, 2 * (d // 2) / 16.0)) ELSE cos(o / pow(10000.0, 2 * (d // 2) / 16.0)) END FROM evs, (SELECT unnest(range(16)) AS d)
  UNION ALL SELECT run_id, pos, event_id, 20, (ts_us - t0_us) / 7200000000.0::DOUBLE FROM evs
  UNION ALL SELECT run_id, pos, event_id, 118, {_SCALED.format(v='value', m=3.0, d=0.5)} FROM evs WHERE event_type = 'RPC_CALL'
  UNION ALL SELECT run_id, pos, event_id, 119, {_SCALED.format(v='floor(value * 10)', m=5.0, d=1.5)} FROM evs WHERE event_type = 'RPC_CALL'
  UNION ALL SELECT run_id, pos, event_id, 120, {_SCALED.format(v='floor(value * 100)', m=8.0, d=0.25)} FROM evs WHERE event_type = 'RPC_CALL'
  UNION ALL SELECT run_id, pos, event_id, 121, ord % 2 FROM evs WHERE event_type = 'RPC_CALL')"""
)
_ROW = "run_id, pos, event_id, i::INTEGER AS i, round(v, 5) + 0.0 AS v"


def _detailed(spark, sf_dir):
    """Event nodes whose optional fields are filled by number, so that each of their slots occurs."""
    third, kind = F.col("ord") % 3, F.col("event_type")
    of = lambda t, *values: F.when(kind == t, F.when(third == 0, values[0]).when(third == 1, values[1]).otherwise(values[2]))
    return _nodes(spark, sf_dir).withColumns({
        "response_flags": of(RPC, "UF, URX", "ZZ,UF,zy", "-"), "grpc_status": of(RPC, None, 0, 13).cast("int"), "reporter_views": F.when(kind == RPC, (F.col("ord") % 2 + 1).cast("int")),
        "drop_reason": of(L4, None, "Policy_Denied", "Stale"), "is_reply": of(L4, True, False, None), "k8s_subresource": of(API, None, "exec", "scale"),
    })


@query(ENTRIES + f" SELECT {_ROW} FROM wide")
def event_feature_vectors(spark, sf_dir):
    """269-wide event vectors, one row for each place that is written."""
    entries = encoding.event_entries(SPEC, F.col("order"), F.col("rel_time"))
    return _detailed(spark, sf_dir).select("run_id", "pos", "event_id", F.inline(entries)).withColumn("v", F.round("v", 5) + F.lit(0.0))


@query(ENTRIES + " SELECT run_id, pos, event_id, count(*) FILTER (WHERE i NOT BETWEEN 147 AND 155) AS filled, round(sum(v * ((i % 7) + 1)) FILTER (WHERE i NOT BETWEEN 147 AND 155), 4) AS weighted, 269 AS width FROM wide WHERE v <> 0 GROUP BY ALL")
def event_features_stripped(spark, sf_dir):
    """Dense event vectors without verdicts and reasons: width, filled places and a weighted sum."""
    dense = encoding.event_features(SPEC, F.col("order"), F.col("rel_time"), strip_verdict=True)
    rows = _detailed(spark, sf_dir).select("run_id", "pos", "event_id", dense.alias("x"))
    add = F.aggregate(F.transform("x", lambda v, i: v * (i % 7 + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select("run_id", "pos", "event_id", F.size(F.filter("x", lambda v: v != 0)).cast("long").alias("filled"), F.round(add, 4).alias("weighted"), F.size("x").alias("width"))


@query(
    INCIDENT
    + f""", w AS (SELECT DISTINCT run_id, pos FROM evs), aged AS (SELECT n.run_id, n.pos AS newest, c.entity_id, n.pos - c.pos AS age FROM w n JOIN copies c ON c.run_id = n.run_id AND c.pos > n.pos - {MEMORY} AND c.pos <= n.pos)
    SELECT run_id, newest, entity_id, age, 1 + count(*) AS width, round(1 + sum((d + 2) * CASE WHEN d % 2 = 0 THEN sin(age / pow(10000.0, 2 * (d // 2) / 16.0)) ELSE cos(age / pow(10000.0, 2 * (d // 2) / 16.0)) END), 4) AS weighted
    FROM aged, (SELECT unnest(range(16)) AS d) GROUP BY ALL"""
)
def entity_feature_vectors(spark, sf_dir):
    """Vectors of entity copies by their age in a memory graph: width, and the sum weighted by place."""
    copies = memory.entity_copies(_incident(spark, sf_dir))
    rows = memory.in_memory(copies, windows.window_table(placed(spark, sf_dir)), MEMORY).withColumn("age", F.col("age").cast("long"))
    rows = rows.select("run_id", "newest", "entity_id", "age", encoding.entity_features(SPEC, F.col("age")).alias("x"))
    add = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select("run_id", "newest", "entity_id", "age", F.size("x").cast("long").alias("width"), F.round(add, 4).alias("weighted"))


@query(
    NODES
    + f""", l AS (SELECT *, CASE WHEN entity_type IN ('Pod', 'Service') THEN canonical_service WHEN entity_type = 'DNSName' THEN 'dnsname' WHEN entity_type = 'KubeAPI' THEN 'kubeapi' END AS label FROM ent),
    named AS (SELECT label, row_number() OVER (ORDER BY label) AS idx FROM (SELECT DISTINCT label FROM l WHERE entity_type <> 'DNSName')), n AS (SELECT count(*) + 1 AS classes FROM named),
    y AS (SELECT run_id, w_idx, entity_id, n.entity_type, coalesce(named.label, '<other>') AS label, coalesce(idx, 0) AS y, {_hash(6, 'run_id', 'w_idx', 'entity_id')} AS number FROM nodes n JOIN l USING (run_id, entity_id) LEFT JOIN named USING (label)),
    v AS (SELECT *, list_transform(range(classes), lambda x: (number % (5 + x) + 1)::DOUBLE) AS v FROM y, n), p AS (SELECT *, list_transform(v, lambda x: x / list_sum(v)) AS probs FROM v),
    t AS (SELECT *, CASE WHEN y = 0 THEN 0 ELSE probs[y + 1] END AS p_true FROM p), names AS (SELECT list_concat(['<other>'], list(label ORDER BY idx)) AS names FROM named)
    SELECT run_id, w_idx, entity_id, entity_type AS node_type, label AS true_label, names[list_position(probs, list_max(probs))] AS pred_label, round(p_true, 6) AS p_true, round(1 - p_true, 6) AS score_raw FROM t, names"""
)
def node_score_records(spark, sf_dir):
    """Scores and predicted roles of nodes at fixed class probabilities, with ties and nodes without role."""
    ents = entities(telemetry(spark, sf_dir))
    vocabulary = written(stats.label_vocabulary(ents.where("entity_type <> 'DNSName'")), "vocabulary")
    nodes = stats.with_label_index(graphs.incident_nodes(placed(spark, sf_dir), ents), vocabulary)
    number = links.draw(6, F.col("run_id"), F.col("w_idx"), F.col("entity_id"))
    classes = vocabulary.agg(F.max("idx").alias("last"))  # one row
    v = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: (number % (i + 5) + 1).cast("double"))
    nodes = nodes.join(F.broadcast(classes)).withColumn("v", v).withColumn("total", F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    scored = models.node_scores(nodes.withColumn("probs", F.transform("v", lambda x: x / F.col("total"))), vocabulary)
    return scored.withColumns({"p_true": F.round("p_true", 6), "score_raw": F.round("score_raw", 6)})
