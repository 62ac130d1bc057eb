"""Queries on windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlog.plans.registry import placed, query
from weftlog.plans.testdata import TEL, WIN, entities, telemetry


@query(WIN + " SELECT run_id, w_idx, src_id AS entity_id, count(*) AS n_events, count(DISTINCT event_type) AS n_types FROM win GROUP BY ALL")
def window_activity(spark, sf_dir):
    """Events and event types of each source in each window."""
    return placed(spark, sf_dir).groupBy("run_id", "w_idx", F.col("src_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("event_type").alias("n_types"))


@query(WIN + " SELECT run_id, pos, w_idx, t0_us, count(*) AS n_events FROM win GROUP BY ALL")
def window_dense_index(spark, sf_dir):
    """Windows by place and by dense index."""
    return placed(spark, sf_dir).groupBy("run_id", "pos", "w_idx", "t0_us").agg(F.count(F.lit(1)).alias("n_events"))


@query(TEL + " SELECT run_id, event_id, event_type, src_id, dst_id, dst_svc_id, method, path, status_code, l4_proto, dst_port, verdict, dns_query, dns_rcode, k8s_verb, k8s_resource, ts_us FROM tel")
def telemetry_events(spark, sf_dir):
    """The adapter's events."""
    return telemetry(spark, sf_dir).select("run_id", "event_id", "event_type", "src_id", "dst_id", "dst_svc_id", "method", "path", "status_code", "l4_proto", "dst_port", "verdict", "dns_query", "dns_rcode", "k8s_verb", "k8s_resource", "ts_us")


@query(TEL + " SELECT run_id, entity_id, entity_type, namespace, canonical_service FROM ent")
def telemetry_entities(spark, sf_dir):
    """Entities named by events."""
    return entities(telemetry(spark, sf_dir)).select("run_id", "entity_id", "entity_type", "namespace", "canonical_service")
