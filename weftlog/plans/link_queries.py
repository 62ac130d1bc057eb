"""Queries on the supervision of link prediction, its losses, and typed message passing."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlog.operators import links, losses, memory, messages
from weftlog.plans.graph_queries import FLOW_MEMORY, INCIDENT, MEMORY, _nodes
from weftlog.plans.registry import query, rounded
from weftlog.plans.testdata import entities, telemetry
from weftlog.scratch import written

SHARE, SEED, MOST, TRIES = 0.3, 17, 2000, 8

TYPED = (
    INCIDENT
    + f""", chain AS MATERIALIZED (SELECT 'follows_src' AS relation, run_id, pos, src_id AS e, event_id, row_number() OVER (PARTITION BY run_id, pos, src_id ORDER BY o) AS i FROM evs
  UNION ALL SELECT 'follows_dst', run_id, pos, dst_id, event_id, row_number() OVER (PARTITION BY run_id, pos, dst_id ORDER BY o) FROM evs),
typed AS (
  SELECT run_id, pos, pos AS later, CASE role WHEN 'src' THEN 'src_of' ELSE 'dst_of' END AS relation, entity_id AS src, event_id AS dst FROM incident
  UNION ALL SELECT run_id, pos, pos, CASE role WHEN 'src' THEN 'rev_src_of' ELSE 'rev_dst_of' END, event_id, entity_id FROM incident WHERE role = 'src' OR event_type <> 'DNS_QUERY'
  UNION ALL SELECT a.run_id, a.pos, a.pos, a.relation, b.event_id, a.event_id FROM chain a JOIN chain b ON a.relation = b.relation AND a.run_id = b.run_id AND a.pos = b.pos AND a.e = b.e AND a.i - b.i BETWEEN 1 AND {FLOW_MEMORY}
  UNION ALL SELECT a.run_id, a.pos, b.pos, 'recurs', a.entity_id, b.entity_id FROM copies a JOIN copies b ON a.run_id = b.run_id AND a.entity_id = b.entity_id AND b.pos - a.pos BETWEEN 1 AND {MEMORY} - 1)"""
)


def _hash(seed: int, *parts: str) -> str:
    return f"CAST('0x' || md5({" || '|' || ".join([f"'{seed}'", *(f'CAST({p} AS VARCHAR)' for p in parts)])})[1:8] AS BIGINT)"


def _link_draw(seed: int) -> str:
    mirrored = "relation LIKE 'rev_%'"
    return _hash(seed, "run_id", "pos", "later", "replace(relation, 'rev_', '')", f"CASE WHEN {mirrored} THEN dst ELSE src END", f"CASE WHEN {mirrored} THEN src ELSE dst END")


SUPERVISED = TYPED + f", supervised AS (SELECT *, {_link_draw(SEED)} < {int(SHARE * links.DRAWS)} AS held FROM typed)"
CAPPED_LINKS = (
    SUPERVISED
    + f""", positives AS (SELECT run_id, pos, later, relation, src, dst FROM
  (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY {_link_draw(SEED + 1)}, run_id, pos, later, src, dst) AS place FROM supervised WHERE held) WHERE place <= {MOST})"""
)
_DRAWN = lambda side, n: _hash(SEED, f"'{side}'", "run_id", "pos", "later", "relation", "of_src", "of_dst", "1", "try") + f" % {n}"
_KEYS = "run_id, pos, later, relation"
SAMPLED = (
    CAPPED_LINKS
    + f""", known AS MATERIALIZED (SELECT DISTINCT {_KEYS}, src, dst FROM typed),
sources AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY src) - 1 AS i_src, count(*) OVER (PARTITION BY {_KEYS}) AS n_src FROM (SELECT DISTINCT {_KEYS}, src FROM known)),
sinks AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY dst) - 1 AS i_dst, count(*) OVER (PARTITION BY {_KEYS}) AS n_dst FROM (SELECT DISTINCT {_KEYS}, dst FROM known)),
sizes AS (SELECT {_KEYS}, n_src, n_dst FROM (SELECT * FROM sources WHERE i_src = 0) JOIN (SELECT * FROM sinks WHERE i_dst = 0) USING ({_KEYS})),
tried AS (SELECT {_KEYS}, src AS of_src, dst AS of_dst, n_src, n_dst, unnest(range({TRIES})) AS try FROM positives JOIN sizes USING ({_KEYS})),
drawn AS MATERIALIZED (SELECT *, {_DRAWN('src', 'n_src')} AS i_src, {_DRAWN('dst', 'n_dst')} AS i_dst FROM tried),
pairs AS (SELECT {_KEYS}, of_src, of_dst, try, src, dst FROM drawn JOIN sources USING ({_KEYS}, i_src) JOIN sinks USING ({_KEYS}, i_dst)),
fine AS (SELECT * FROM pairs ANTI JOIN known USING ({_KEYS}, src, dst) WHERE src <> dst),
negatives AS (SELECT DISTINCT {_KEYS}, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS}, of_src, of_dst ORDER BY try) AS nth FROM fine) WHERE nth = 1)"""
)
#: A made-up but fixed logit of a pair, from -4 to 4.
_LOGIT_SQL = f"(({_hash(3, 'run_id', 'pos', 'later', 'relation', 'src', 'dst')} % 8001) / 1000.0::DOUBLE - 4)"


def _parts(spark, sf_dir):
    ents = entities(telemetry(spark, sf_dir))
    nodes = written(_nodes(spark, sf_dir), "event-nodes")
    incident = written(memory.incidence(nodes, ents), "incident")
    return nodes, incident, written(memory.entity_copies(incident), "copies")


def _typed(spark, sf_dir):
    return written(memory.typed_edges(*_parts(spark, sf_dir), FLOW_MEMORY, MEMORY), "typed")


def _positives(typed):
    held = links.supervised(typed, SHARE, SEED).where("held").drop("held")
    return links.smallest(held, "relation", links.link_draw(SEED + 1), MOST, "run_id", "pos", "later", "src", "dst")


@query(SUPERVISED + " SELECT relation, held, count(*) AS n, count(DISTINCT run_id || '|' || pos || '|' || least(src, dst) || '|' || greatest(src, dst)) AS n_pairs FROM supervised GROUP BY ALL")
def relation_holdout(spark, sf_dir):
    """Typed edges by relation, and how many are kept from the messages; mirrored ones together."""
    marked = links.supervised(_typed(spark, sf_dir), SHARE, SEED)
    pair = F.concat_ws("|", "run_id", "pos", F.least("src", "dst"), F.greatest("src", "dst"))
    return marked.groupBy("relation", "held").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(pair).alias("n_pairs"))


@query(CAPPED_LINKS + " SELECT * FROM positives")
def relation_positives(spark, sf_dir):
    """Held-out links, at most 2,000 of each relation."""
    return _positives(_typed(spark, sf_dir))


@query(SAMPLED + " SELECT * FROM negatives")
def relation_negatives(spark, sf_dir):
    """Non-edges of each relation within its graphs, drawn again where they hit an edge."""
    typed = _typed(spark, sf_dir)
    return links.relation_negatives(written(_positives(typed), "positives"), typed, 1, SEED, TRIES)


def _scored(spark, sf_dir):
    typed = _typed(spark, sf_dir)
    positives = written(_positives(typed), "positives")
    negatives = links.relation_negatives(positives, typed, 1, SEED, TRIES)
    both = positives.withColumn("positive", F.lit(True)).unionByName(negatives.withColumn("positive", F.lit(False)))
    number = links.draw(3, *map(F.col, (*links.GRAPH, "src", "dst")))
    return both.withColumn("logit", (number % 8001) / 1000.0 - 4)


_SCORED = SAMPLED + f", scored AS (SELECT *, {_LOGIT_SQL} AS logit FROM (SELECT *, true AS positive FROM positives UNION ALL SELECT *, false FROM negatives))"
_BCE = "greatest(logit, 0) - CASE WHEN positive THEN logit ELSE 0 END + ln(1 + exp(-abs(logit)))"


@query(_SCORED + f" SELECT relation, count(*) AS n, count(*) FILTER (WHERE positive) AS n_pos, round(avg({_BCE}), 6) AS loss FROM scored GROUP BY relation")
def link_losses(spark, sf_dir):
    """Mean loss of each relation at fixed logits."""
    return losses.relation_losses(_scored(spark, sf_dir), "logit", "positive").withColumns(rounded("loss"))


@query(_SCORED + f", per AS (SELECT relation, avg({_BCE}) AS loss FROM scored GROUP BY relation HAVING count(*) FILTER (WHERE positive) > 0) SELECT round(avg(loss), 6) AS loss, count(*) AS relations FROM per")
def link_loss_macro(spark, sf_dir):
    """Relations weigh alike in the loss of link prediction."""
    return losses.macro_link_loss(_scored(spark, sf_dir), "logit", "positive").withColumns(rounded("loss"))


_CLASSED = (
    INCIDENT
    + f""", classed AS (SELECT run_id, pos, entity_id, {_hash(5, "'y'", 'entity_id')} % 5 AS y, list_transform([1, 2, 3, 4, 5], lambda x: ({_hash(6, 'run_id', 'pos', 'entity_id')} % (96 + x) + 1)::DOUBLE) AS v FROM copies),
probable AS (SELECT *, list_transform(v, lambda x: x / list_sum(v)) AS probs FROM classed)"""
)


def _classed(spark, sf_dir):
    copies = _parts(spark, sf_dir)[2]
    number = links.draw(6, F.col("run_id"), F.col("pos"), F.col("entity_id"))
    v = F.array(*[(number % (96 + x) + 1).cast("double") for x in range(1, 6)])
    total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b)
    return copies.withColumns({"y": links.draw(5, F.lit("y"), F.col("entity_id")) % 5, "v": v}).withColumn("probs", F.transform("v", lambda x: x / total)).withColumn("y", F.col("y").cast("int"))


@query(
    _CLASSED
    + """, n AS (SELECT y, count(*) AS n FROM probable WHERE y > 0 GROUP BY y), w AS (SELECT y, (SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n::DOUBLE) AS w FROM n)
    SELECT round(sum(w * -ln(probs[y + 1])) / sum(w), 6) AS weighted, count(*) AS n, (SELECT round(avg(l), 6) FROM (SELECT avg(-ln(probs[y + 1])) AS l FROM probable WHERE y > 0 GROUP BY y)) AS macro, count(DISTINCT y) AS classes FROM probable JOIN w USING (y)"""
)
def class_losses(spark, sf_dir):
    """Loss of role classification at fixed probabilities: weighted by class, and as a mean over classes."""
    from weftlog.operators.stats import class_weights

    rows = written(_classed(spark, sf_dir), "classed")
    weights = class_weights(rows, "y", F.col("y") == 0).select("y", "weight")
    weighted = losses.class_loss(rows.join(weights, "y"), "probs", "y", "weight").select(F.round("loss", 6).alias("weighted"), "n")
    macro = losses.macro_class_loss(rows, "probs", "y").select(F.round("loss", 6).alias("macro"), "classes")
    return weighted.join(F.broadcast(macro))  # one row each


#: Small vectors, so that both engines can pass them on.
WIDTH = 3
_CONSTANTS = (0.3141592653589793, 0.2718281828459045)
_NODES = (
    TYPED
    + f""", nodes0 AS (
  SELECT run_id, pos, 'event' AS kind, event_id AS id, unnest(range({WIDTH})) AS i, unnest([(ts_us - t0_us) / 7200000000.0::DOUBLE, (o % 5) * {_CONSTANTS[0]}::DOUBLE, length(event_type) * -{_CONSTANTS[1]}::DOUBLE]) AS v FROM evs
  UNION ALL SELECT run_id, pos, 'entity', entity_id, unnest(range({WIDTH})), unnest([1.0::DOUBLE, length(entity_id) * {_CONSTANTS[0]}::DOUBLE, 0.0::DOUBLE]) FROM copies),
ways AS (SELECT *, CASE WHEN relation IN ('src_of', 'dst_of', 'recurs') THEN 'entity' ELSE 'event' END AS kind, CASE WHEN relation IN ('rev_src_of', 'rev_dst_of', 'recurs') THEN 'entity' ELSE 'event' END AS to_kind,
  list_position(['src_of', 'rev_src_of', 'dst_of', 'rev_dst_of', 'follows_src', 'follows_dst', 'recurs'], relation) - 1 AS turn FROM typed)"""
)


def _pass_sql(number: int, temporal: bool) -> str:
    """SQL of one pass, from table nodes{number} to nodes{number + 1}."""
    where, event, entity = ("IN ('follows_src', 'follows_dst', 'recurs')", 2, 1) if temporal else ("NOT IN ('follows_src', 'follows_dst', 'recurs')", 2, 2)
    return f""", means{number} AS (SELECT w.run_id, w.later AS pos, w.to_kind AS kind, w.dst AS id, w.relation, (n.i - w.turn % {WIDTH} + {WIDTH}) % {WIDTH} AS i, avg(n.v) AS v
  FROM ways w JOIN nodes{number} n ON n.run_id = w.run_id AND n.pos = w.pos AND n.kind = w.kind AND n.id = w.src WHERE w.relation {where} GROUP BY ALL),
sums{number} AS (SELECT run_id, pos, kind, id, i, sum(v) AS v FROM means{number} GROUP BY ALL),
both{number} AS (SELECT n.run_id, n.pos, n.kind, n.id, n.i, n.v * CASE n.kind WHEN 'event' THEN {event} ELSE {entity} END + coalesce(s.v, 0) AS v FROM nodes{number} n LEFT JOIN sums{number} s USING (run_id, pos, kind, id, i)),
nodes{number + 1} AS (SELECT run_id, pos, kind, id, i, CASE WHEN v >= 0 THEN v ELSE v * 0.01::DOUBLE END AS v FROM both{number})"""


@query(
    _NODES + _pass_sql(0, True) + _pass_sql(1, False) + _pass_sql(2, True) + _pass_sql(3, False) + """ SELECT run_id, pos, kind, id, max(v) FILTER (WHERE i = 0) AS a, max(v) FILTER (WHERE i = 1) AS b, max(v) FILTER (WHERE i = 2) AS c FROM
    (SELECT * REPLACE (round(v, 6) + 0.0 AS v) FROM nodes4) GROUP BY ALL"""
)
def typed_passes(spark, sf_dir):
    """Two layers of typed messages without fitted transforms: temporal, spatial, temporal, spatial."""
    nodes, incident, copies = _parts(spark, sf_dir)
    edges = written(messages.weighted(memory.other_edges(incident, copies, MEMORY)), "weighted")
    chains = written(memory.follow_ends(nodes), "chains")
    said = F.array((F.col("ts_us") - F.col("t0_us")) / 7_200_000_000.0, (F.col("order") % 5) * _CONSTANTS[0], F.length("event_type") * -_CONSTANTS[1])
    rows = nodes.select("run_id", "pos", F.lit("event").alias("kind"), F.col("event_id").alias("id"), said.alias("x"))
    known = copies.select("run_id", "pos", F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.array(F.lit(1.0), F.length("entity_id") * _CONSTANTS[0], F.lit(0.0)).alias("x"))
    out = messages.layer(messages.layer(rows.unionByName(known), edges, WIDTH, chains, FLOW_MEMORY), edges, WIDTH, chains, FLOW_MEMORY)
    return out.select("run_id", "pos", "kind", "id", *[(F.round(F.get("x", F.lit(i)), 6) + F.lit(0.0)).alias(name) for i, name in enumerate("abc")])
