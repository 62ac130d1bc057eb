"""Queries on statistics, alerts and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlog.operators import alerts, splits, stats
from weftlog.plans.registry import placed, query, rounded, table
from weftlog.plans.testdata import TEL, WIN, entities, telemetry


@query(TEL + ", l AS (SELECT DISTINCT CASE WHEN entity_type IN ('Pod', 'Service') THEN canonical_service WHEN entity_type = 'DNSName' THEN 'dnsname' WHEN entity_type = 'KubeAPI' THEN 'kubeapi' END AS label FROM ent) SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS idx FROM l UNION ALL SELECT '<other>', 0")
def label_vocab(spark, sf_dir):
    """Role labels, the other class first."""
    return stats.label_vocabulary(entities(telemetry(spark, sf_dir)))


@query(
    TEL
    + """, l AS (SELECT *, CASE WHEN entity_type IN ('Pod', 'Service') THEN canonical_service WHEN entity_type = 'DNSName' THEN 'dnsname' WHEN entity_type = 'KubeAPI' THEN 'kubeapi' END AS label FROM ent),
    v AS (SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS idx FROM (SELECT DISTINCT label FROM l WHERE entity_type <> 'DNSName'))
    SELECT run_id, entity_id, coalesce(v.label, '<other>') AS label, coalesce(idx, 0) AS y FROM l LEFT JOIN v USING (label)"""
)
def label_index(spark, sf_dir):
    """Labels by a vocabulary that lacks one type."""
    ents = entities(telemetry(spark, sf_dir))
    return stats.with_label_index(ents, stats.label_vocabulary(ents.where("entity_type <> 'DNSName'"))).select("run_id", "entity_id", "label", "y")


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), t AS (SELECT sum(n) AS t, count(*) AS k FROM c WHERE label <> 0) SELECT label, n, round(CASE WHEN label = 0 THEN 0 ELSE t / (k * n) END, 6) AS weight FROM c, t")
def class_weights(spark, sf_dir):
    """Balanced class weights with one class left out."""
    return stats.class_weights(table(spark, sf_dir, "embeddings"), "label", F.col("label") == 0).withColumns(rounded("weight"))


@query("WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents), c AS (SELECT token, count(*) AS n, min(doc_id) AS seen, min(token) AS m FROM t WHERE token <> '' GROUP BY token) SELECT token, CAST(row_number() OVER (ORDER BY n DESC, seen, token) AS INTEGER) AS idx FROM c QUALIFY idx <= 63")
def topk_vocab(spark, sf_dir):
    """The 63 most frequent tokens, ties by the first document and token."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("token")).where("token <> ''")
    return stats.top_vocabulary(rows, "token", "doc_id", 64)


@query("SELECT round(avg(ln(1 + l_extendedprice)), 6) AS l_extendedprice_mean, round(stddev_pop(ln(1 + l_extendedprice)), 6) AS l_extendedprice_dev, round(avg(ln(1 + l_quantity)), 6) AS l_quantity_mean, round(stddev_pop(ln(1 + l_quantity)), 6) AS l_quantity_dev FROM lineitem")
def log1p_scaler(spark, sf_dir):
    """Scalers of two columns."""
    out = stats.log_scalers(table(spark, sf_dir, "lineitem"), ("l_extendedprice", "l_quantity"))
    return out.withColumns(rounded(*out.columns))


@query("SELECT l_returnflag AS node_type, round(quantile_cont(l_extendedprice, 0.995), 4) AS threshold FROM lineitem GROUP BY 1")
def quantile_threshold(spark, sf_dir):
    """Exact quantiles by group."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("node_type"), F.col("l_extendedprice").alias("score_raw"))
    return alerts.quantile_thresholds(rows).withColumn("threshold", F.round("threshold", 4))


@query(
    """WITH t AS (SELECT l_returnflag AS g, l_quantity AS v FROM lineitem), c AS (SELECT g, v, sum(count(*)) OVER (PARTITION BY g ORDER BY v) AS upto, sum(count(*)) OVER (PARTITION BY g) AS total FROM t GROUP BY g, v),
    q AS (SELECT l_orderkey, l_linenumber, l_returnflag AS g, l_quantity + 0.5 * (l_orderkey % 2) AS v FROM lineitem),
    r AS (SELECT g, v, coalesce((SELECT max(upto) FROM c WHERE c.g = d.g AND c.v < d.v), 0) + coalesce((SELECT max(upto) FROM c WHERE c.g = d.g AND c.v <= d.v), 0) AS twice, (SELECT max(total) FROM c WHERE c.g = d.g) AS total FROM (SELECT DISTINCT g, v FROM q) d)
    SELECT l_orderkey, l_linenumber, g AS node_type, v AS score_raw, round(twice / (2.0::DOUBLE * total), 6) AS score_norm FROM q JOIN r USING (g, v)"""
)
def midrank_normalize(spark, sf_dir):
    """Mid-ranks of scores in a table of other scores."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "node_type")
    benign = rows.select("node_type", F.col("l_quantity").alias("score_raw"))
    scores = rows.select("l_orderkey", "l_linenumber", "node_type", (F.col("l_quantity") + 0.5 * (F.col("l_orderkey") % 2)).alias("score_raw"))
    return alerts.normalised(scores, benign).select("l_orderkey", "l_linenumber", "node_type", "score_raw", F.round("score_norm", 6).alias("score_norm"))


_SCORED = WIN + ", scored AS (SELECT run_id, w_idx, src_id AS entity_id, max(value) AS score FROM win GROUP BY ALL)"


def _scored(spark, sf_dir):
    """Pods of windows scored by the largest value of their events."""
    value = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), "value")
    rows = placed(spark, sf_dir).join(value, "event_id").groupBy("run_id", "w_idx", F.col("src_id").alias("entity_id")).agg(F.max("value").alias("score_norm"))
    label = F.concat(F.lit("s"), (F.regexp_extract("entity_id", r"([0-9]+)$", 1).cast("long") % 10).cast("string"))
    return rows.withColumns({"node_type": F.lit("Pod"), "true_label": F.when(F.col("w_idx") % 7 == 0, "<other>").otherwise(label), "pred_label": F.when(F.col("w_idx") % 3 == 0, label).otherwise("s1")})


@query(_SCORED + " SELECT run_id, entity_id, count(*) AS windows, round(max(score), 6) AS max_score, round(list_avg(list_reverse_sort(list(score))[1:3]), 6) AS top3_mean, bool_or(score >= 150.0) AS is_alert FROM scored GROUP BY ALL")
def pod_alerts(spark, sf_dir):
    """Pods by their scores."""
    thresholds = spark.createDataFrame([("Pod", 150.0)], "node_type string, threshold double")
    out = alerts.pod_alerts(alerts.apply_thresholds(_scored(spark, sf_dir), thresholds)).withColumns(rounded("max_score", "top3_mean"))
    return alerts.ordered_alerts(out).select("run_id", "entity_id", "windows", "max_score", "top3_mean", "is_alert")


@query(
    _SCORED
    + """, l AS (SELECT *, 's' || (CAST(regexp_extract(entity_id, '([0-9]+)$', 1) AS BIGINT) % 10) AS own FROM scored)
    SELECT count(*) AS node_windows, round(avg(CASE WHEN w_idx % 7 <> 0 THEN ((CASE WHEN w_idx % 3 = 0 THEN own ELSE 's1' END) <> own)::INT END), 6) AS misclassification_rate, round(avg((score >= 150.0)::INT), 6) AS alert_rate FROM l"""
)
def benign_fp(spark, sf_dir):
    """Wrong labels and alerts among pods."""
    thresholds = spark.createDataFrame([("Pod", 150.0)], "node_type string, threshold double")
    return alerts.benign_fp(alerts.apply_thresholds(_scored(spark, sf_dir), thresholds)).withColumns(rounded("misclassification_rate", "alert_rate"))


@query(
    """WITH j AS (SELECT n_chars AS v, quality = 1 AS p FROM documents JOIN labels USING (doc_id)), r AS (SELECT p, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM j)
    SELECT round((sum(CASE WHEN p THEN r END) - count(*) FILTER (WHERE p) * (count(*) FILTER (WHERE p) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE p) * count(*) FILTER (WHERE NOT p)), 6) AS auc, count(*) FILTER (WHERE p) AS n_pos, count(*) FILTER (WHERE NOT p) AS n_neg FROM r"""
)
def auc_midrank(spark, sf_dir):
    """Chance that a good document is the longer one."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.auc(joined, "n_chars", F.col("quality") == 1).withColumns(rounded("auc"))


@query(
    _SCORED
    + """, f AS (SELECT DISTINCT run_id, w_idx, entity_id FROM (SELECT run_id, w_idx, src_id AS entity_id FROM win WHERE event_type = 'L4_FLOW' AND verdict <> 'FORWARDED' UNION ALL SELECT run_id, w_idx, dst_id FROM win WHERE event_type = 'L4_FLOW' AND verdict <> 'FORWARDED'))
    SELECT s.run_id, s.w_idx, s.entity_id, f.entity_id IS NOT NULL AS is_flagged FROM scored s LEFT JOIN f ON s.run_id = f.run_id AND s.w_idx = f.w_idx AND s.entity_id = f.entity_id"""
)
def weak_signal_flags(spark, sf_dir):
    """Pods of windows with a flow that was not forwarded."""
    return alerts.flagged(_scored(spark, sf_dir), alerts.dropped_endpoints(placed(spark, sf_dir))).select("run_id", "w_idx", "entity_id", "is_flagged")


@query(
    _SCORED
    + """, v AS (SELECT run_id, min(entity_id) AS victim FROM scored GROUP BY 1), t AS (SELECT run_id, max(score) AS top FROM scored JOIN v USING (run_id) WHERE entity_id = victim GROUP BY 1)
    SELECT round(avg((top >= 100.0)::INT), 6) AS detection_rate, count(*) AS runs FROM t"""
)
def detection_rate(spark, sf_dir):
    """Runs whose victim is found."""
    scores = _scored(spark, sf_dir)
    victims = scores.groupBy("run_id").agg(F.min("entity_id").alias("entity_id"))
    return alerts.detection_rate(scores.join(victims, ["run_id", "entity_id"]), 100.0).withColumns(rounded("detection_rate"))


@query(
    TEL
    + """, r AS (SELECT run_id, row_number() OVER (ORDER BY split_part(run_id, '_', -1), run_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT run_id FROM tel))
    SELECT run_id, place, CASE WHEN place >= n - greatest(1, round_even(n * 0.15, 0)) THEN 'test' WHEN place >= n - greatest(1, round_even(n * 0.15, 0)) - greatest(1, round_even(n * 0.25, 0)) THEN 'val' ELSE 'train' END AS split FROM r"""
)
def temporal_split(spark, sf_dir):
    """Runs split by time."""
    return splits.temporal_split(telemetry(spark, sf_dir).select("run_id").distinct(), 0.25, 0.15)


@query("SELECT label, i, round(avg(e::DOUBLE), 5) + 0.0 AS v FROM (SELECT label, unnest(embedding) AS e, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def mean_pooling(spark, sf_dir):
    """Mean vectors of groups (A10)."""
    from weftlog.operators.graphs import mean_vector

    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x"))
    out = rows.groupBy("label").agg(mean_vector("x").alias("x")).select("label", F.posexplode("x").alias("i", "v"))
    return out.select("label", F.col("i").cast("long").alias("i"), (F.round("v", 5) + F.lit(0.0)).alias("v"))
