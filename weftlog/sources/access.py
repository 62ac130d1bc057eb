"""Proxy access logs: one view of a request for each line, merged by request id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions import net
from weftlog.schema import EXTERNAL, POD, RPC, SERVICE
from weftlog.sources.snapshot import resolve_ip

#: Fields of a JSON line. Numbers are read as text, since some writers quote them.
FIELDS = (
    "start_time", "method", "path", "protocol", "response_code", "response_flags", "bytes_received", "bytes_sent", "duration", "user_agent", "request_id", "upstream_host", "upstream_cluster",
    "downstream_remote_address", "grpc_status",
)
#: Fields that say nothing more once a view's request, direction and ends are known.
_MET_BEFORE = ("start_time", "request_id", "upstream_host", "upstream_cluster", "downstream_remote_address")
#: The text layout, field by field and separated by blanks; a name marks what is kept. Fixed values.
_QUOTED, _WORD, _NUMBER = '"([^"]*)"', r"(\S+)", r"(\d+)"
TEXT_LAYOUT = (
    ("start_time", r"\[([^\]]+)\]"), (("method", "path", "protocol"), r'"(\S+) (\S+) ([^"]+)"'), ("response_code", _NUMBER), ("response_flags", _WORD), (None, r"\S+"), (None, r"\S+"), (None, '"[^"]*"'),
    ("bytes_received", _NUMBER), ("bytes_sent", _NUMBER), ("duration", _NUMBER), (None, r"\S+"), (None, '"[^"]*"'), ("user_agent", _QUOTED), ("request_id", _QUOTED), (None, '"[^"]*"'),
    ("upstream_host", _QUOTED), ("upstream_cluster", _WORD), (None, r"\S+"), (None, r"\S+"), ("downstream_remote_address", _WORD),
)
TEXT_PATTERN = "^" + " ".join(p for _, p in TEXT_LAYOUT)
_GROUPS = [x for n, _ in TEXT_LAYOUT if n for x in ((n,) if isinstance(n, str) else n)]


def parsed(lines: DataFrame) -> DataFrame:
    """The lines with rec and ts_us, of those that are JSON with a start and a method, or of the text layout.

    A text line is matched once: its groups come back one a line, and no line holds an end of line.  The record is generated, so that
    the filters on it and all who use it do not parse again.
    """
    json = F.from_json("line", ", ".join(f"{f} string" for f in FIELDS))
    parts = F.split(F.regexp_replace("line", f"(?s){TEXT_PATTERN}.*$", "\n".join(f"${i + 1}" for i in range(len(_GROUPS)))), "\n", -1)
    part = lambda f: F.get("parts", F.lit(_GROUPS.index(f))) if f in _GROUPS else F.lit(None).cast("string")
    found = lines.select("*", F.explode(F.array(F.when(~F.col("line").startswith("{"), parts))).alias("parts"))
    text = F.when(F.size("parts") == len(_GROUPS), F.struct(*[part(f).alias(f) for f in FIELDS]))
    out = found.select(*lines.columns, F.explode(F.array(F.when(F.col("parts").isNull(), json).otherwise(text))).alias("rec"))
    return out.withColumn("ts_us", net.epoch_us(F.col("rec.start_time"))).where(F.col("ts_us").isNotNull() & F.col("rec.method").isNotNull())


def merged_views(views: DataFrame, payload: list[str], order: str = "seen") -> DataFrame:
    """(run_id, request_id, outbound, inbound, turn, reporter_views): views of requests, paired.

    The first outbound and the first inbound view of a request id are one request; any other view, also one without id or of
    unknown direction, is a request of its own and stands in ``outbound`` unless it came in.  Views of one id meet by one shuffle,
    one sort and one window; a view that cannot be paired is spread by its order.
    """
    c = F.col
    named = F.coalesce((c("request_id") != "") & c("direction").isin("outbound", "inbound"), F.lit(False))
    keys = ["run_id", "_named", "request_id", "_apart"]
    body = F.struct("direction", order, *payload)
    rows = views.select("run_id", "request_id", "direction", named.alias("_named"), F.when(~named, F.xxhash64(order)).alias("_apart"), body.alias("body"))
    # inbound views come before outbound ones: the first row holds the inbound view that is paired, if any, and the last tells of an outbound one
    one = Window.partitionBy(*keys).orderBy("direction", f"body.{order}")
    whole = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    came, out = c("direction") == "inbound", c("direction") == "outbound"
    rows = rows.withColumns({"_met": F.first("body").over(whole), "_last": F.last("direction").over(whole), "_before": F.lag("direction").over(one)})
    first = c("_named") & ~F.coalesce(c("_before") == c("direction"), F.lit(False))
    rows = rows.where(~(first & came & (c("_last") == "outbound")))  # it stands in the row of its outbound view
    inbound = F.when(first & out & (c("_met.direction") == "inbound"), c("_met")).when(came, c("body"))
    both = rows.select("run_id", "request_id", F.when(~came, c("body")).alias("outbound"), inbound.alias("inbound"), F.when(~first, 2).when(came, 1).otherwise(0).alias("turn"))
    count = F.when(c("outbound").isNotNull(), 1).otherwise(0) + F.when(c("inbound").isNotNull(), 1).otherwise(0)
    return both.withColumn("reporter_views", count)


def rpc_events(lines: DataFrame, addresses: DataFrame, first_by: tuple[str, ...] = ("file", "lineno"), ends: bool = False) -> DataFrame:
    """Events of (run_id, pod, file, lineno, line): ``pod`` is the reporting pod's id. A pair goes from pod to pod, with what the server saw.

    Of views that share a request id and a direction, that which is smallest by the columns ``first_by`` of ``lines`` is paired.
    With ``ends`` only whom the events name is told, and nothing else is shuffled.
    """
    rec = F.struct(*[F.col(f"rec.{f}").alias(f) for f in FIELDS if f not in _MET_BEFORE])
    views = parsed(lines).select(
        "run_id", net.present(F.col("rec.request_id")).alias("request_id"), net.upstream_direction(F.col("rec.upstream_cluster")).alias("direction"), F.struct(*first_by).alias("nth"), F.struct("file", "lineno").alias("seen"), "pod", rec.alias("rec"), "ts_us",
        net.service_id(net.upstream_service(F.col("rec.upstream_cluster"))).alias("service"), net.host_of(F.col("rec.downstream_remote_address")).alias("ip"),
    )
    merged = merged_views(views, ["pod", "service", "ip"] if ends else ["seen", "pod", "rec", "ts_us", "service", "ip"], "nth")
    merged = resolve_ip(merged.withColumn("ip", F.col("inbound.ip")), addresses, "ip", "from")
    c, seen = F.col, F.coalesce("inbound", "outbound")
    out, came = c("outbound").isNotNull(), c("inbound").isNotNull()
    rows = merged.select("run_id", seen.alias("v"), "turn", "reporter_views", *([] if ends else [F.coalesce("outbound.seen", "inbound.seen").alias("seen")]),
        F.when(out, c("outbound.pod")).otherwise(F.coalesce("from_id", F.lit("ext:world"))).alias("src_id"), F.when(out, POD).otherwise(F.coalesce("from_type", F.lit(EXTERNAL))).alias("src_type"),
        F.when(came, c("inbound.pod")).otherwise(F.coalesce("outbound.service", F.lit("ext:world"))).alias("dst_id"),
        F.when(came, POD).when(c("outbound.service").isNotNull(), SERVICE).otherwise(EXTERNAL).alias("dst_type"), c("outbound.service").alias("dst_svc_id"), F.when(~came, c("outbound.ip")).alias("unused_ip"),
    )
    also = F.when(c("v.direction") != "inbound", c("v.ip")).alias("also_ip")
    if ends:
        return rows.select("run_id", "src_id", "dst_id", "dst_svc_id", also)
    number = lambda name, kind: F.coalesce(c(f"v.rec.{name}").try_cast(kind), F.lit(0).cast(kind)).alias(name)
    grpc = c("v.rec.grpc_status")
    return rows.select(
        F.concat_ws(":", "run_id", "v.seen.file", c("v.seen.lineno").cast("string")).alias("event_id"), "run_id", (c("v.ts_us") / 1e6).alias("ts"), c("v.ts_us").alias("ts_us"), F.lit(RPC).alias("event_type"),
        "src_id", "src_type", "dst_id", "dst_type", "dst_svc_id", net.rpc_protocol(c("v.rec.user_agent"), c("v.rec.path"), c("v.rec.protocol")).alias("protocol"), c("v.rec.method").alias("method"), c("v.rec.path").alias("path"),
        number("response_code", "int").alias("status_code"), F.when(~grpc.isin("", "-"), grpc.try_cast("int")).alias("grpc_status"), F.coalesce(net.present(c("v.rec.response_flags")), F.lit("-")).alias("response_flags"),
        number("duration", "double").alias("duration_ms"), number("bytes_received", "long").alias("request_bytes"), number("bytes_sent", "long").alias("response_bytes"), "reporter_views",
        F.struct(F.lit(0), "turn", c("seen.file"), c("seen.lineno")).alias("order"), also,
    )
