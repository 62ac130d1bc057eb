"""Tables of the telemetry model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RPC, L4, DNS, API = "RPC_CALL", "L4_FLOW", "DNS_QUERY", "K8S_API_CALL"
#: Order is part of the feature layout.
EVENT_TYPES = (RPC, L4, DNS, API)

POD, SERVICE, WORKLOAD, DNSNAME, EXTERNAL, KUBEAPI = "Pod", "Service", "Workload", "DNSName", "ExternalEndpoint", "KubeAPI"
#: A type's place is its node type number.
ENTITY_TYPES = (POD, SERVICE, WORKLOAD, DNSNAME, EXTERNAL, KUBEAPI)
KUBEAPI_ID = "kubeapi:cluster"
OTHER = "<other>"


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType()}


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in spec.split(","))])


EVENTS = _schema(
    "event_id string, run_id string, ts double, event_type string, src_id string, src_type string, dst_id string, dst_type string, dst_svc_id string, "
    "protocol string, method string, path string, status_code int, grpc_status int, response_flags string, duration_ms double, request_bytes long, response_bytes long, reporter_views int, "
    "l4_proto string, dst_port int, verdict string, drop_reason string, is_reply boolean, dns_query string, dns_qtypes string, dns_rcode string, "
    "k8s_verb string, k8s_resource string, k8s_subresource string, k8s_user_type string, k8s_status_code int, label string, label_source string"
)
#: Besides the public columns: exact time, and the order of ingest, which breaks ties in time.
INTERNAL = _schema("ts_us long, ord long")
ENTITIES = _schema(
    "run_id string, entity_id string, entity_type string, name string, namespace string, canonical_service string, workload string, node_name string, pod_ip string, service_account string, uid string, has_sidecar boolean"
)
#: What token and feature builders may see of an event: behaviour only, nothing that names an endpoint.
BEHAVIOUR = (
    "event_type", "protocol", "method", "path", "status_code", "response_flags", "l4_proto", "dst_port", "verdict", "dns_qtypes", "dns_query", "dns_rcode",
    "k8s_verb", "k8s_resource", "k8s_subresource", "k8s_user_type", "k8s_status_code", "grpc_status", "duration_ms", "request_bytes", "response_bytes", "reporter_views", "drop_reason", "is_reply",
)
SCORES = _schema("run_id string, w_idx long, entity_id string, node_type string, true_label string, pred_label string, p_true double, score_raw double, score_norm double")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; absent ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def as_events(df: DataFrame) -> DataFrame:
    """Any table of event columns as events with exact time and ingest order; NaN counts as null."""
    out = conform(df, T.StructType(EVENTS.fields + INTERNAL.fields))
    clean = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in EVENTS if f.dataType == T.DoubleType()}
    out = out.withColumns(clean)
    return out.withColumns({"ts_us": F.coalesce("ts_us", F.round(F.col("ts") * 1_000_000).cast("long")), "ord": F.coalesce("ord", F.lit(0).cast("long"))})
