"""Queries on scalar functions, tokens and sentences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftlog.functions import encoding, net, tokens
from weftlog.operators import sentences, windows
from weftlog.plans.registry import placed, query, table
from weftlog.plans.testdata import WIN, WINDOWS, telemetry

#: SQL of some scalar functions, as macros of one argument or two.
def fill(template: str, **values: str) -> str:
    """A template with {name} replaced."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", value)
    return template


_ID_LIKE = """(regexp_matches({s}, '^[0-9]+$') OR regexp_matches({s}, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') OR regexp_matches({s}, '^[0-9a-f]{8,}$')
  OR (regexp_matches({s}, '^[a-z0-9]{8,}$') AND regexp_matches({s}, '[0-9]')) OR (length({s}) >= 6 AND 2 * length(regexp_replace({s}, '[^0-9]', '', 'g')) > length({s})))"""
_CUT = "lower(split_part(split_part({p}, '?', 1), '#', 1))"
_TEMPLATE = "'/' || array_to_string([CASE WHEN " + fill(_ID_LIKE, s="s") + " THEN '*' ELSE s END FOR s IN string_split(" + _CUT + ", '/')[2:5]], '/')"
_PORT_CASE = "CASE {p} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in tokens.PORT_CLASSES.items()) + " ELSE CASE WHEN {p} IS NULL THEN 'na' WHEN {p} < 1024 THEN 'system' WHEN {p} < 49152 THEN 'registered' ELSE 'ephemeral' END END"
_STATUS = "CASE WHEN {c} IS NULL OR {c} = 0 THEN 'na' ELSE CAST({c} // 100 AS VARCHAR) || 'xx' END"
_INTERNAL = " OR ".join(f"ends_with({{n}}, '{s}')" for s in tokens.INTERNAL_SUFFIXES)
_DNS = "CASE WHEN {n} IS NULL OR {n} = '' THEN 'dst:na' WHEN " + _INTERNAL + " OR NOT contains({n}, '.') THEN 'dst:cluster' ELSE 'dst:ext:' || array_to_string(string_split({n}, '.')[-2:], '.') END"

_PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1)"
_HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


def _path():
    return F.regexp_extract("url", "^[a-z]+://[^/]+(.*)$", 1)


@query(f"SELECT page_id, CASE WHEN {_PATH_SQL} = '' THEN '/' ELSE {fill(_TEMPLATE, p=_PATH_SQL)} END AS template FROM pages")
def path_template(spark, sf_dir):
    """Page paths without ids."""
    return table(spark, sf_dir, "pages").select("page_id", tokens.template_path(_path(), F.lit("http")).alias("template"))


@query(f"SELECT page_id, '/*/' || lower(split_part({_HOST_SQL}, '.', 1)) AS template FROM pages")
def grpc_template(spark, sf_dir):
    """gRPC paths keep the method alone."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    path = F.concat(F.lit("/shop.Service/"), F.substring_index(host, ".", 1))
    return table(spark, sf_dir, "pages").select("page_id", tokens.template_path(path, F.lit("grpc")).alias("template"))


@query(f"SELECT page_id, {fill(_DNS, n='n')} AS token FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN h WHEN 1 THEN split_part(h, '.', 1) || '.default.svc.cluster.local' WHEN 2 THEN split_part(h, '.', 1) ELSE h || '..' END AS raw, lower(rtrim(CASE page_id % 4 WHEN 0 THEN h WHEN 1 THEN split_part(h, '.', 1) || '.default.svc.cluster.local' WHEN 2 THEN split_part(h, '.', 1) ELSE h || '..' END, '.')) AS n FROM (SELECT page_id, {_HOST_SQL} AS h FROM pages))")
def dns_dst_token(spark, sf_dir):
    """Names inside and outside the cluster."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    first = F.substring_index(host, ".", 1)
    name = F.when(F.col("page_id") % 4 == 0, host).when(F.col("page_id") % 4 == 1, F.concat(first, F.lit(".default.svc.cluster.local"))).when(F.col("page_id") % 4 == 2, first).otherwise(F.concat(host, F.lit("..")))
    return table(spark, sf_dir, "pages").select("page_id", tokens.dns_token(name).alias("token"))


@query(f"SELECT page_id, seg, {fill(_ID_LIKE, s='seg')} AS id_like FROM (SELECT page_id, unnest(string_split(lower({_PATH_SQL}), '/')) AS seg FROM pages) WHERE seg <> ''")
def id_like(spark, sf_dir):
    """Path segments that look like ids."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split(F.lower(_path()), "/")).alias("seg")).where("seg <> ''")
    return rows.select("page_id", "seg", tokens.is_id_like(F.col("seg")).alias("id_like"))


@query(WIN + f" SELECT event_id, pos, {fill(_PORT_CASE, p='dst_port')} AS port, {fill(_STATUS, c='status_code')} AS status, lower(coalesce(verdict, 'na')) AS verdict FROM win")
def port_and_status_class(spark, sf_dir):
    """Port, status and verdict classes."""
    c = F.col
    return placed(spark, sf_dir).select("event_id", "pos", tokens.port_class(c("dst_port")).alias("port"), tokens.status_class(c("status_code")).alias("status"), tokens.verdict_token(c("verdict")).alias("verdict"))


_HASHISH = "(regexp_matches({s}, '^[a-z0-9]{4,11}$') AND regexp_matches({s}, '[0-9]'))"


@query(
    f"""WITH n AS (SELECT p_partkey, 'part-' || CASE p_partkey % 3 WHEN 0 THEN 'a' || p_partkey || 'bc-x' || (p_partkey * 7919) % 99991 || 'z' WHEN 1 THEN 'n' || (p_partkey * 31) % 9973 || 'q' ELSE 'client' END AS name FROM part),
    s AS (SELECT *, string_split(name, '-') AS parts FROM n)
    SELECT p_partkey, name, CASE WHEN len(parts) >= 3 AND {fill(_HASHISH, s='parts[-1]')} AND {fill(_HASHISH, s='parts[-2]')} THEN array_to_string(parts[:-3], '-')
      WHEN len(parts) >= 2 AND {fill(_HASHISH, s='parts[-1]')} THEN array_to_string(parts[:-2], '-') ELSE name END AS stripped FROM s"""
)
def strip_pod_hash(spark, sf_dir):
    """Names without generated suffixes."""
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, F.concat(F.lit("a"), k, F.lit("bc-x"), (k * 7919) % 99991, F.lit("z"))).when(k % 3 == 1, F.concat(F.lit("n"), (k * 31) % 9973, F.lit("q"))).otherwise("client")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("part-"), kind).alias("name")).withColumn("stripped", net.strip_pod_hash(F.col("name")))


@query(
    """SELECT s_suppkey, CASE WHEN d IN ('outbound', 'inbound') THEN d ELSE 'unknown' END AS direction,
      CASE WHEN d = 'outbound' THEN 'svc:ns' || s_nationkey || '/svc' || s_suppkey END AS service, '10.0.' || s_nationkey || '.' || s_suppkey % 250 AS host
    FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'outbound' WHEN 1 THEN 'inbound' ELSE 'passthrough' END AS d FROM supplier)"""
)
def upstream_cluster(spark, sf_dir):
    """Direction, service and host of an upstream."""
    c = F.col
    kind = F.when(c("s_suppkey") % 3 == 0, "outbound").when(c("s_suppkey") % 3 == 1, "inbound").otherwise("passthrough")
    fqdn = F.concat(F.lit("Svc"), c("s_suppkey"), F.lit(".ns"), c("s_nationkey"), F.lit(".svc.cluster.local."))
    cluster = F.concat(kind, F.lit("|8080||"), F.when(kind == "outbound", fqdn).otherwise(""))
    address = F.concat(F.lit("10.0."), c("s_nationkey"), F.lit("."), c("s_suppkey") % 250, F.lit(":8080"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", net.upstream_direction(cluster).alias("direction"), net.service_id(net.upstream_service(cluster)).alias("service"), net.host_of(address).alias("host"))


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'sa' WHEN 1 THEN 'node' ELSE 'user' END AS user_type, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN 'grpc' ELSE 'http' END AS protocol,
      CASE c_custkey % 4 WHEN 0 THEN 'canon' WHEN 1 THEN 'app' || c_nationkey WHEN 2 THEN 'owner' ELSE 'pod' END AS service FROM customer"""
)
def user_protocol_service(spark, sf_dir):
    """User types, protocols and canonical services."""
    c, k = F.col, F.col("c_custkey")
    user = F.when(k % 4 == 0, "system:serviceaccount:default:x").when(k % 4 == 1, "system:node:n1").when(k % 4 == 2, "admin")
    agent = F.when(k % 5 == 0, "grpc-go/1.0").otherwise("curl")
    path, proto = F.when(k % 3 == 0, "/shop.Cart/Get").otherwise("/cart/get"), F.lit("HTTP/2")
    service = net.canonical_service(F.when(k % 4 == 0, "canon"), F.when(k % 4 == 1, F.concat(F.lit("app"), c("c_nationkey"))).otherwise(""), F.when(k % 4 == 2, "owner-7c4d9b8f66"), F.lit("pod-7c4d9b8f66-pq2rs"))
    return table(spark, sf_dir, "customer").select("c_custkey", net.user_type(user).alias("user_type"), net.rpc_protocol(agent, path, proto).alias("protocol"), service.alias("service"))


@query("SELECT event_id, epoch_us(ts) AS ts_us, CAST(NULL AS BIGINT) AS bad FROM events")
def iso_parse_epoch(spark, sf_dir):
    """ISO text back to time."""
    text = F.concat(F.regexp_replace(F.col("ts").cast("string"), " ", "T"), F.lit("Z"))
    return table(spark, sf_dir, "events").select("event_id", net.epoch_us(text).alias("ts_us"), net.epoch_us(F.concat(F.lit("x"), text)).alias("bad"))


_TOKENS = f"""CASE event_type
  WHEN 'RPC_CALL' THEN ['rpc:' || d, 'proto:http', 'm:' || lower(method), 'p:' || {fill(_TEMPLATE, p='path')}, 'st:' || {fill(_STATUS, c='status_code')}]
  WHEN 'L4_FLOW' THEN ['flow:' || d, 'proto:' || l4_proto, 'port:' || {fill(_PORT_CASE, p='dst_port')}, 'v:' || lower(verdict)]
  WHEN 'DNS_QUERY' THEN CASE d WHEN 'out' THEN ['dns:q', 'qt:a', {fill(_DNS, n='dns_query')}, 'rc:' || lower(coalesce(dns_rcode, 'na'))] ELSE ['dns:in', 'qt:a', 'rc:' || lower(coalesce(dns_rcode, 'na'))] END
  ELSE ['api:' || d, 'verb:' || k8s_verb, 'res:' || k8s_resource, 'ut:sa', 'st:2xx'] END"""
VIEWS = (
    WIN
    + """, sides AS (
  SELECT *, src_id AS entity_id, 'out' AS d, 0 AS seq FROM win UNION ALL SELECT *, dst_id, 'in', 1 FROM win
  UNION ALL SELECT *, dst_svc_id, 'in', 2 FROM win WHERE dst_svc_id IS NOT NULL AND dst_svc_id <> dst_id),
views AS (SELECT run_id, w_idx, pos, ts_us, ord, seq, entity_id, d, """
    + _TOKENS
    + " AS tokens FROM sides)"
)
CAPPED = VIEWS + """, numbered AS (
  SELECT *, row_number() OVER w AS nth, first_value(ts_us) OVER w AS f_ts, first_value(ord) OVER w AS f_ord, first_value(seq) OVER w AS f_seq FROM views
  WINDOW w AS (PARTITION BY run_id, w_idx, entity_id, tokens ORDER BY ts_us, ord, seq)),
capped AS (SELECT * FROM numbered WHERE nth <= 3),
sent AS (SELECT run_id, w_idx, entity_id, flatten(list(tokens ORDER BY ts_us, f_ts, f_ord, f_seq, nth)) AS s FROM capped GROUP BY ALL)"""


def _tokenised(spark, sf_dir, strip_verdict=False):
    return windows.assign_windows(sentences.tokenised(telemetry(spark, sf_dir), strip_verdict), WINDOWS)


@query(VIEWS + " SELECT run_id, w_idx, ord, entity_id, d AS direction, seq, array_to_string(tokens, ' ') AS tokens FROM views")
def token_stream(spark, sf_dir):
    """Tokens of events as their endpoints see them."""
    return sentences.token_views(_tokenised(spark, sf_dir)).select("run_id", "w_idx", "ord", "entity_id", "direction", "seq", F.array_join("tokens", " ").alias("tokens"))


@query(VIEWS.replace(", 'v:' || lower(verdict)]", "]") + " SELECT run_id, w_idx, ord, entity_id, array_to_string(tokens, ' ') AS tokens FROM views WHERE starts_with(tokens[1], 'flow:')")
def token_stream_stripped(spark, sf_dir):
    """Flow tokens without verdicts."""
    rows = sentences.token_views(_tokenised(spark, sf_dir, True)).where(F.get("tokens", 0).startswith("flow:"))
    return rows.select("run_id", "w_idx", "ord", "entity_id", F.array_join("tokens", " ").alias("tokens"))


@query(CAPPED + " SELECT run_id, w_idx, entity_id, array_to_string(s, ' ') AS sentence FROM sent")
def sentence_capped(spark, sf_dir):
    """Sentences with at most three repeats of a token tuple."""
    out = sentences.sentences(_tokenised(spark, sf_dir), 3, 1_000_000)
    return out.select("run_id", "w_idx", "entity_id", F.array_join("sentence", " ").alias("sentence"))


@query(CAPPED + " SELECT run_id, w_idx, entity_id, len(s) AS n, array_to_string(CASE WHEN len(s) > 12 THEN [s[CAST(floor(i * (len(s) / 12.0::DOUBLE)) AS BIGINT) + 1] FOR i IN range(12)] ELSE s END, ' ') AS sentence FROM sent")
def sentence_tokens_sampled(spark, sf_dir):
    """Long sentences sampled evenly."""
    out = sentences.sentences(_tokenised(spark, sf_dir), 3, 1_000_000).withColumn("n", F.size("sentence").cast("long"))
    return out.select("run_id", "w_idx", "entity_id", "n", F.array_join(sentences.sample_evenly(F.col("sentence"), 12), " ").alias("sentence"))


@query(
    """WITH t AS (SELECT unnest(string_split(text, ' ')) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY token)
    SELECT CASE WHEN n >= 2 THEN token ELSE 'unk:' || coalesce(nullif(split_part(token, ':', 1), ''), 'misc') END AS mapped, sum(n)::BIGINT AS n FROM c GROUP BY 1"""
)
def unk_mapping(spark, sf_dir):
    """Rare tokens fall into buckets."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("token")).where("token <> ''")
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.when(F.col("n") >= 2, F.col("token")).otherwise(tokens.unknown_token(F.col("token"))).alias("mapped"), "n").groupBy("mapped").agg(F.sum("n").alias("n"))


_SLOTS = "['" + "', '".join(encoding.VERDICTS) + "']"


@query(WIN + f" SELECT event_id, pos, CASE WHEN list_contains({_SLOTS}, lower(coalesce(verdict, 'na'))) THEN list_position({_SLOTS}, lower(coalesce(verdict, 'na'))) - 1 ELSE list_position({_SLOTS}, 'other') - 1 END AS slot FROM win")
def slot_encode(spark, sf_dir):
    """Verdicts as slots."""
    return placed(spark, sf_dir).select("event_id", "pos", encoding.slot(F.col("verdict"), encoding.VERDICTS).alias("slot"))


_ANGLE = "p / pow(10000.0, 2 * (i // 2) / 16.0)"


@query(
    WIN
    + f""", places AS (SELECT DISTINCT pos AS p FROM win), v AS (SELECT p, i, CASE WHEN i % 2 = 0 THEN sin({_ANGLE}) ELSE cos({_ANGLE}) END AS v FROM places, (SELECT unnest(range(16)) AS i))
    SELECT p, i, round(v, 6) + 0.0 AS v FROM v"""
)
def positional_encoding(spark, sf_dir):
    """Sines and cosines of the positions of windows."""
    places = placed(spark, sf_dir).select(F.col("pos").cast("long").alias("p")).distinct()
    rows = places.select("p", F.posexplode(encoding.positional_encoding(F.col("p"), 16)).alias("i", "v"))
    return rows.select("p", F.col("i").cast("long").alias("i"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


@query("SELECT l_orderkey, l_linenumber, round(greatest(-5.0, least(5.0, (ln(1 + greatest(l_extendedprice, 0)) - 9.0) / 0.5)), 6) AS z FROM lineitem")
def scaled_clip(spark, sf_dir):
    """Standardised logarithms within five deviations."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(encoding.scaled(F.col("l_extendedprice"), 9.0, 0.5), 6).alias("z"))


@query(
    """WITH s AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations)
    SELECT conv_id, count(*) AS turns, string_agg(text, ' ' ORDER BY turn) AS joined FROM s WHERE nth <= 2 GROUP BY conv_id"""
)
def conversation_capped(spark, sf_dir):
    """First two turns of each role in a conversation."""
    rows = table(spark, sf_dir, "conversations").withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))).where("nth <= 2")
    kept = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return kept.select("conv_id", "turns", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("joined"))
