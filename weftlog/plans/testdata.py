"""Telemetry tables derived from the generic ``events`` table, so that operators can run on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.operators.windows import WindowSpec
from weftlog.scratch import roomy
from weftlog.schema import API, DNS, DNSNAME, KUBEAPI, KUBEAPI_ID, L4, POD, RPC, SERVICE, as_events

#: Two-hour windows each hour; the table is sparse.
WINDOWS = WindowSpec.seconds(7200, 3600, 1800)
PORTS = (53, 80, 443, 7070, 6379, 9999, 50000, 22)


def epoch_micros(ts: Column) -> Column:
    """Microseconds of a zoneless time read as UTC, whatever the session's zone."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    roomy(spark, f"{sf_dir}/events.parquet")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    kind = F.when(F.col("event_type").isin("click", "view"), RPC).when(F.col("event_type") == "purchase", L4).when(F.col("event_type") == "signup", DNS).otherwise(API)
    rows = raw.withColumns({"kind": kind, "verb": F.col("event_type")})
    k, c = F.col("k"), F.col
    is_ = lambda *t: c("kind").isin(*t)
    only = lambda t, value: F.when(is_(t), value)
    say = lambda head, value: F.concat(F.lit(head), value.cast("string"))
    name = F.concat(say("h", k % 20), say(".example", k % 5), F.lit(".com"))
    out = rows.select(
        c("event_id").cast("string").alias("event_id"), F.concat(F.lit("bench-mix_"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), epoch_micros(c("ts")).alias("ts_us"),
        c("event_id").cast("long").alias("ord"), c("kind").alias("event_type"), say("pod:default/u", c("user_id")).alias("src_id"), F.lit(POD).alias("src_type"),
        F.when(is_(RPC, L4), say("pod:default/u", (c("user_id") * 7 + k) % 15)).when(is_(DNS), F.concat(F.lit("dns:"), name)).otherwise(KUBEAPI_ID).alias("dst_id"),
        F.when(is_(RPC, L4), POD).when(is_(DNS), DNSNAME).otherwise(KUBEAPI).alias("dst_type"),
        only(RPC, F.when(k % 2 == 0, say("svc:default/s", k % 10))).alias("dst_svc_id"), only(RPC, F.lit("http")).alias("protocol"),
        only(RPC, F.when(c("verb") == "click", "GET").otherwise("POST")).alias("method"), only(RPC, F.concat(say("/item/", k), F.lit("/view"))).alias("path"),
        only(RPC, F.when(k % 20 == 0, 500).when(k % 10 == 1, 404).otherwise(200)).alias("status_code"), only(RPC, c("value")).alias("duration_ms"),
        only(RPC, F.floor(c("value") * 10)).alias("request_bytes"), only(RPC, F.floor(c("value") * 100)).alias("response_bytes"),
        only(L4, F.when(k % 3 == 0, "tcp").when(k % 3 == 1, "udp").otherwise("icmp")).alias("l4_proto"),
        only(L4, F.element_at(F.array(*[F.lit(p) for p in PORTS]), k % 8 + 1)).alias("dst_port"),
        only(L4, F.when(k % 10 == 0, "DROPPED").when(k % 10 == 1, "POLICY_DENIED").otherwise("FORWARDED")).alias("verdict"),
        only(DNS, name).alias("dns_query"), only(DNS, F.lit("A,AAAA")).alias("dns_qtypes"),
        only(DNS, F.when(k % 4 == 0, "0").when(k % 4 == 1, "3").when(k % 4 == 2, "NXDOMAIN")).alias("dns_rcode"),
        only(API, F.element_at(F.array(*[F.lit(v) for v in ("get", "list", "watch", "create")]), k % 4 + 1)).alias("k8s_verb"),
        only(API, F.element_at(F.array(*[F.lit(v) for v in ("pods", "secrets", "configmaps")]), k % 3 + 1)).alias("k8s_resource"),
        only(API, F.lit("sa")).alias("k8s_user_type"), only(API, F.lit(200)).alias("k8s_status_code"), (epoch_micros(c("ts")) / 1e6).alias("ts"),
    )
    return as_events(out)


def entities(events: DataFrame) -> DataFrame:
    """The entities that a run's events name; a pod's service follows from its number."""
    c = F.col
    end = lambda who, kind: F.struct(who.alias("entity_id"), kind.alias("entity_type"))
    ends = F.filter(F.array(end(c("src_id"), c("src_type")), end(c("dst_id"), c("dst_type")), end(c("dst_svc_id"), F.lit(SERVICE))), lambda e: e["entity_id"].isNotNull())
    rows = events.select("run_id", F.inline(ends)).distinct()
    number = F.regexp_extract("entity_id", r"/u([0-9]+)$", 1)
    return rows.select(
        "run_id", "entity_id", "entity_type", F.substring_index("entity_id", "/", -1).alias("name"), F.when(c("entity_type").isin(POD, SERVICE), "default").alias("namespace"),
        F.when(c("entity_type") == POD, F.concat(F.lit("s"), (F.try_to_number(number, F.lit("999999999999")) % 10).cast("long").cast("string"))).when(c("entity_type") == SERVICE, F.substring_index("entity_id", "/", -1)).alias("canonical_service"),
    )


#: The same tables in SQL: tel (events), ent (entities), win (events by window).
TEL = """
WITH raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
tel AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS ord, 'bench-mix_' || strftime(ts, '%Y%m%d') AS run_id, epoch_us(ts) AS ts_us, user_id, k, value,
    CASE WHEN event_type IN ('click', 'view') THEN 'RPC_CALL' WHEN event_type = 'purchase' THEN 'L4_FLOW' WHEN event_type = 'signup' THEN 'DNS_QUERY' ELSE 'K8S_API_CALL' END AS event_type,
    'pod:default/u' || user_id AS src_id, 'Pod' AS src_type,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'pod:default/u' || ((user_id * 7 + k) % 15)
      WHEN event_type = 'signup' THEN 'dns:h' || (k % 20) || '.example' || (k % 5) || '.com' ELSE 'kubeapi:cluster' END AS dst_id,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'Pod' WHEN event_type = 'signup' THEN 'DNSName' ELSE 'KubeAPI' END AS dst_type,
    CASE WHEN event_type IN ('click', 'view') AND k % 2 = 0 THEN 'svc:default/s' || (k % 10) END AS dst_svc_id,
    CASE WHEN event_type = 'click' THEN 'GET' WHEN event_type = 'view' THEN 'POST' END AS method,
    CASE WHEN event_type IN ('click', 'view') THEN '/item/' || k || '/view' END AS path,
    CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN k % 20 = 0 THEN 500 WHEN k % 10 = 1 THEN 404 ELSE 200 END END AS status_code,
    CASE WHEN event_type IN ('click', 'view') THEN value END AS duration_ms,
    CASE WHEN event_type = 'purchase' THEN CASE k % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END END AS l4_proto,
    CASE WHEN event_type = 'purchase' THEN [53, 80, 443, 7070, 6379, 9999, 50000, 22][k % 8 + 1] END AS dst_port,
    CASE WHEN event_type = 'purchase' THEN CASE k % 10 WHEN 0 THEN 'DROPPED' WHEN 1 THEN 'POLICY_DENIED' ELSE 'FORWARDED' END END AS verdict,
    CASE WHEN event_type = 'signup' THEN 'h' || (k % 20) || '.example' || (k % 5) || '.com' END AS dns_query,
    CASE WHEN event_type = 'signup' THEN CASE k % 4 WHEN 0 THEN '0' WHEN 1 THEN '3' WHEN 2 THEN 'NXDOMAIN' END END AS dns_rcode,
    CASE WHEN event_type = 'error' THEN ['get', 'list', 'watch', 'create'][k % 4 + 1] END AS k8s_verb,
    CASE WHEN event_type = 'error' THEN ['pods', 'secrets', 'configmaps'][k % 3 + 1] END AS k8s_resource
  FROM raw
),
ends AS (
  SELECT run_id, src_id AS entity_id, src_type AS entity_type FROM tel UNION SELECT run_id, dst_id, dst_type FROM tel UNION SELECT run_id, dst_svc_id, 'Service' FROM tel WHERE dst_svc_id IS NOT NULL
),
ent AS (
  SELECT run_id, entity_id, entity_type, CASE WHEN entity_type IN ('Pod', 'Service') THEN 'default' END AS namespace,
    CASE WHEN entity_type = 'Pod' THEN 's' || (CAST(regexp_extract(entity_id, '/u([0-9]+)$', 1) AS BIGINT) % 10) WHEN entity_type = 'Service' THEN split_part(entity_id, '/', 2) END AS canonical_service
  FROM ends
)"""
WIN = (
    TEL
    + f""",
spans AS (SELECT run_id, min(ts_us) AS s, max(ts_us) AS e FROM tel GROUP BY run_id),
fulls AS (SELECT *, CASE WHEN e - s >= {WINDOWS.width} THEN (e - s - {WINDOWS.width}) // {WINDOWS.stride} + 1 ELSE 0 END AS f FROM spans),
lasts AS (SELECT run_id, s, CASE WHEN f = 0 OR e - s - f * {WINDOWS.stride} >= {WINDOWS.least_tail} THEN f ELSE f - 1 END AS last FROM fulls),
placed AS (
  SELECT tel.*, s, unnest(range(CAST(greatest(0, floor((ts_us - s - {WINDOWS.width}) / {WINDOWS.stride}::DOUBLE) + 1) AS BIGINT), least((ts_us - s) // {WINDOWS.stride}, last) + 1)) AS pos
  FROM tel JOIN lasts USING (run_id)
),
win AS (SELECT *, s + pos * {WINDOWS.stride} AS t0_us, dense_rank() OVER (PARTITION BY run_id ORDER BY pos) - 1 AS w_idx FROM placed)"""
)
