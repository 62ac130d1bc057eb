"""Queries on interaction graphs and memory graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlog.operators import graphs, memory, windows
from weftlog.plans.registry import placed, query, table
from weftlog.plans.testdata import TEL, WIN, WINDOWS, entities, telemetry
from weftlog.scratch import written

MEMORY, CAP, FLOW_MEMORY = 5, 1000, 20
#: The cap that the query on capping shows.
SHOWN_CAP = 10

NODES = WIN + """, inc AS (
  SELECT run_id, w_idx, pos, src_id AS entity_id FROM win UNION SELECT run_id, w_idx, pos, dst_id FROM win UNION SELECT run_id, w_idx, pos, dst_svc_id FROM win WHERE dst_svc_id IS NOT NULL),
nodes AS (SELECT inc.*, entity_type, canonical_service, namespace FROM inc JOIN ent USING (run_id, entity_id)),
pairs AS (
  SELECT DISTINCT run_id, w_idx, pos, src_id AS src, dst_id AS dst FROM win WHERE src_id <> dst_id
  UNION SELECT run_id, w_idx, pos, src_id, dst_svc_id FROM win WHERE event_type = 'RPC_CALL' AND dst_svc_id IS NOT NULL AND dst_svc_id <> dst_id),
both_ways AS (SELECT * FROM pairs UNION SELECT run_id, w_idx, pos, dst, src FROM pairs)"""


@query(NODES + " SELECT run_id, w_idx, entity_id, entity_type, canonical_service FROM nodes")
def incident_nodes(spark, sf_dir):
    """Nodes of window graphs."""
    return graphs.incident_nodes(placed(spark, sf_dir), entities(telemetry(spark, sf_dir))).select("run_id", "w_idx", "entity_id", "entity_type", "canonical_service")


@query(NODES + " SELECT run_id, w_idx, src, dst FROM pairs")
def window_edges_distinct(spark, sf_dir):
    """Distinct edges without loops."""
    return graphs.window_edges(placed(spark, sf_dir), entities(telemetry(spark, sf_dir)), reverse=False).select("run_id", "w_idx", "src", "dst")


@query(NODES + " SELECT run_id, w_idx, src, dst FROM both_ways")
def reverse_edges(spark, sf_dir):
    """Edges with their reverses."""
    return graphs.window_edges(placed(spark, sf_dir), entities(telemetry(spark, sf_dir))).select("run_id", "w_idx", "src", "dst")


@query(
    NODES
    + """, feats AS (SELECT run_id, w_idx, entity_id, embedding FROM nodes JOIN embeddings ON vec_id = TRY_CAST(regexp_extract(entity_id, '/u([0-9]+)$', 1) AS BIGINT) % (SELECT count(*) FROM embeddings) WHERE entity_type = 'Pod'),
    m AS (SELECT run_id, w_idx, dst AS entity_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM both_ways JOIN feats USING (run_id, w_idx) WHERE src = entity_id),
    a AS (SELECT run_id, w_idx, entity_id, i, avg(v::DOUBLE) AS v FROM m GROUP BY ALL)
    SELECT run_id, w_idx, entity_id, count(*) AS size, round(sum(v), 5) + 0.0 AS total, round(sum(v * (i + 1)), 4) + 0.0 AS weighted FROM a GROUP BY ALL"""
)
def neighbor_mean(spark, sf_dir):
    """Mean vectors of neighbours, as sums over their dimensions."""
    place, ents = written(placed(spark, sf_dir), "placed"), entities(telemetry(spark, sf_dir))
    n = table(spark, sf_dir, "embeddings").count()
    pods = graphs.incident_nodes(place, ents).where("entity_type = 'Pod'").withColumn("vec_id", F.regexp_extract("entity_id", r"/u([0-9]+)$", 1).try_cast("long") % n)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    mean = graphs.neighbour_mean(graphs.window_edges(place, ents), pods, ["run_id", "w_idx"], vectors=vectors)
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v)
    weighted = F.transform("x", lambda v, i: v * (i + 1))
    return mean.select("run_id", "w_idx", "entity_id", F.size("x").cast("long").alias("size"), (F.round(add("x"), 5) + F.lit(0.0)).alias("total"), (F.round(add(weighted), 4) + F.lit(0.0)).alias("weighted"))


def _capped(cap: int) -> str:
    return WIN + f""", marked AS (SELECT *, coalesce(event_type = 'L4_FLOW' AND verdict IS NOT NULL AND verdict <> 'FORWARDED', false) AS must FROM win),
counted AS (SELECT *, count(*) OVER (PARTITION BY run_id, pos) AS n, count(*) FILTER (WHERE must) OVER (PARTITION BY run_id, pos) AS n_must,
  row_number() OVER (PARTITION BY run_id, pos, must ORDER BY ts_us, ord) - 1 AS i FROM marked),
picks AS (SELECT DISTINCT run_id, pos, CASE WHEN j = room - 1 AND room > 1 THEN rest - 1 ELSE CAST(floor(j * ((rest - 1)::DOUBLE / greatest(room - 1, 1))) AS BIGINT) END AS i
  FROM (SELECT run_id, pos, rest, room, unnest(range(room)) AS j FROM (SELECT DISTINCT run_id, pos, n - n_must AS rest, greatest({cap} - n_must, 0) AS room FROM counted WHERE n > {cap}) WHERE rest > 0)),
capped AS (SELECT c.* FROM counted c LEFT JOIN picks p ON c.run_id = p.run_id AND c.pos = p.pos AND c.i = p.i AND NOT c.must WHERE n <= {cap} OR must OR p.i IS NOT NULL),
evs AS (SELECT *, row_number() OVER (PARTITION BY run_id, pos ORDER BY ts_us, event_id) - 1 AS o FROM capped)"""


CAPPED = _capped(CAP)
INCIDENT = CAPPED + """, incident AS (
  SELECT run_id, pos, event_id, event_type, src_id AS entity_id, 'src' AS role FROM evs UNION ALL SELECT run_id, pos, event_id, event_type, dst_id, 'dst' FROM evs
  UNION ALL SELECT run_id, pos, event_id, event_type, dst_svc_id, 'dst' FROM evs WHERE event_type = 'RPC_CALL' AND dst_svc_id IS NOT NULL AND dst_svc_id <> dst_id),
copies AS (SELECT DISTINCT run_id, pos, entity_id FROM incident)"""


def _nodes(spark, sf_dir, cap=CAP):
    return memory.event_nodes(memory.cap_events(windows.positioned(telemetry(spark, sf_dir), WINDOWS), cap), 7_200_000_000)


def _incident(spark, sf_dir):
    return memory.incidence(_nodes(spark, sf_dir), entities(telemetry(spark, sf_dir)))


@query(_capped(SHOWN_CAP) + " SELECT run_id, pos, event_id, o AS \"order\", round((ts_us - t0_us) / 7200000000.0::DOUBLE, 6) AS rel_time FROM evs")
def event_cap(spark, sf_dir):
    """Capped windows with order and relative time."""
    return _nodes(spark, sf_dir, SHOWN_CAP).select("run_id", "pos", "event_id", F.col("order").cast("long").alias("order"), F.round("rel_time", 6).alias("rel_time"))


@query(
    INCIDENT
    + """ SELECT run_id, pos, CASE WHEN role = 'src' THEN 'src_of' ELSE 'dst_of' END AS edge_type, event_id, entity_id FROM incident
    UNION ALL SELECT run_id, pos, CASE WHEN role = 'src' THEN 'rev_src_of' ELSE 'rev_dst_of' END, event_id, entity_id FROM incident WHERE role = 'src' OR event_type <> 'DNS_QUERY'"""
)
def spatial_edges(spark, sf_dir):
    """Edges between events and entities."""
    return memory.spatial_edges(_incident(spark, sf_dir)).select("run_id", "pos", "edge_type", "event_id", "entity_id")


@query(
    CAPPED
    + f""", r AS (SELECT 'follows_src' AS edge_type, run_id, pos, src_id AS e, event_id, row_number() OVER (PARTITION BY run_id, pos, src_id ORDER BY o) AS i FROM evs
      UNION ALL SELECT 'follows_dst', run_id, pos, dst_id, event_id, row_number() OVER (PARTITION BY run_id, pos, dst_id ORDER BY o) FROM evs)
    SELECT a.run_id, a.pos, a.edge_type, b.event_id AS src, a.event_id AS dst FROM r a JOIN r b ON a.edge_type = b.edge_type AND a.run_id = b.run_id AND a.pos = b.pos AND a.e = b.e AND a.i - b.i BETWEEN 1 AND {FLOW_MEMORY}"""
)
def follows_chain_capped(spark, sf_dir):
    """Chains of events with the same end."""
    return memory.follow_edges(_nodes(spark, sf_dir), FLOW_MEMORY).select("run_id", "pos", "edge_type", "src", "dst")


@query(
    INCIDENT
    + f""", w AS (SELECT DISTINCT run_id, pos FROM evs)
    SELECT n.run_id, n.pos AS newest, a.entity_id, n.pos - a.pos AS age, b.pos - a.pos AS ahead
    FROM w n JOIN copies a ON a.run_id = n.run_id AND a.pos > n.pos - {MEMORY} AND a.pos <= n.pos JOIN copies b ON b.run_id = a.run_id AND b.entity_id = a.entity_id AND b.pos > a.pos AND b.pos <= n.pos"""
)
def window_memory_recurrence(spark, sf_dir):
    """Recurrence edges in the memory of each window."""
    incident = written(_incident(spark, sf_dir), "incident")
    edges = memory.recurrence_edges(memory.entity_copies(incident), MEMORY)
    rows = memory.in_memory(edges, windows.window_table(placed(spark, sf_dir)), MEMORY).where("later <= newest")
    return rows.select("run_id", "newest", "entity_id", F.col("age").cast("long").alias("age"), (F.col("later") - F.col("pos")).alias("ahead"))


@query(
    INCIDENT
    + f""", w AS (SELECT DISTINCT run_id, pos FROM evs)
    SELECT n.run_id, n.pos AS newest, count(*) AS copies, count(*) FILTER (WHERE c.pos = n.pos) AS scored FROM w n JOIN copies c ON c.run_id = n.run_id AND c.pos > n.pos - {MEMORY} AND c.pos <= n.pos GROUP BY ALL"""
)
def memory_copies(spark, sf_dir):
    """Entity copies in each memory graph, and those of the newest window."""
    copies = memory.entity_copies(_incident(spark, sf_dir))
    rows = memory.in_memory(copies, windows.window_table(placed(spark, sf_dir)), MEMORY)
    return rows.groupBy("run_id", "newest").agg(F.count(F.lit(1)).alias("copies"), F.count_if(F.col("age") == 0).alias("scored"))


EDGES = TEL + """, e AS (SELECT DISTINCT src_id AS src, dst_id AS dst, CAST(regexp_extract(src_id, '([0-9]+)$', 1) AS BIGINT) AS a, CAST(regexp_extract(dst_id, '([0-9]+)$', 1) AS BIGINT) AS b
  FROM tel WHERE event_type = 'RPC_CALL' AND src_id <> dst_id)"""


def _edges(spark, sf_dir):
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    rows = telemetry(spark, sf_dir).where("event_type = 'RPC_CALL' AND src_id <> dst_id").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct()
    return rows.withColumns({"a": number("src"), "b": number("dst")})


@query(EDGES + " SELECT src, dst, (least(a, b) * 31 + greatest(a, b) * 17) % 10 < 3 AS held_out FROM e")
def link_holdout(spark, sf_dir):
    """Links held out together with their reverses."""
    from weftlog.operators.links import held_out

    return _edges(spark, sf_dir).select("src", "dst", held_out(F.col("a"), F.col("b")).alias("held_out"))


@query(
    EDGES
    + """, d AS (SELECT DISTINCT dst, b FROM e), n AS (SELECT count(*) AS n FROM d), ranked AS (SELECT dst, b, row_number() OVER (ORDER BY b, dst) - 1 AS i FROM d),
    cand AS (SELECT DISTINCT e.src, r.dst FROM e CROSS JOIN n JOIN ranked r ON r.i = (e.a * 13 + e.b * 7 + 1) % n.n)
    SELECT src, dst FROM cand WHERE src <> dst AND (src, dst) NOT IN (SELECT src, dst FROM e)"""
)
def negative_edges(spark, sf_dir):
    """Non-edges drawn for each edge by an arithmetic hash."""
    from weftlog.operators.links import negatives

    return negatives(_edges(spark, sf_dir))
