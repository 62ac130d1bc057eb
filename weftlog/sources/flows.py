"""Network flows and name queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.functions import net
from weftlog.schema import DNS, DNSNAME, EXTERNAL, L4, POD
from weftlog.sources.snapshot import resolve_ip

_END = "struct<pod_name: string, namespace: string, labels: array<string>, workloads: array<struct<name: string>>, ip: string>"
_PORT = "struct<destination_port: int, flags: struct<SYN: boolean, ACK: boolean>>"
#: Fields of a record and their types.
FIELDS = {
    "time": "string", "verdict": "string", "drop_reason_desc": "string", "is_reply": "boolean", "l4": f"struct<TCP: {_PORT}, UDP: {_PORT}, ICMPv4: struct<type: int>, ICMPv6: struct<type: int>>",
    "l7": "struct<type: string, dns: struct<query: string, qtypes: array<string>, rcode: string>>", "source": _END, "destination": _END,
}
#: Which flows may be kept; each rule is enough. Fixed values.
RULES = ("non_forwarded", "syn_no_ack", "udp_first")


def keep(verdict: Column, proto: Column, syn: Column, ack: Column, is_reply: Column, rules: tuple[str, ...] = RULES) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    tests = {
        "non_forwarded": F.coalesce(verdict, F.lit("UNKNOWN")) != "FORWARDED", "syn_no_ack": (proto == "tcp") & yes(syn) & ~yes(ack), "udp_first": proto.isin("udp", "icmp") & ~yes(is_reply),
    }
    out = F.lit(False)
    for rule in rules:
        out = out | yes(tests[rule])
    return out


def parsed(lines: DataFrame) -> DataFrame:
    """(run_id, file, lineno, f, ts_us) of JSON lines with a time, wrapped in ``flow`` or bare."""
    inner, outer = (", ".join(f"{n}{sep} {t}" for n, t in FIELDS.items()) for sep in (":", ""))
    # generated, so that the filters on a record and all who use it do not parse again
    out = lines.select("*", F.explode(F.array(F.from_json("line", f"flow struct<{inner}>, {outer}"))).alias("o"))
    wrapped = F.col("o.flow").isNotNull()
    f = F.struct(*[F.when(wrapped, F.col(f"o.flow.{x}")).otherwise(F.col(f"o.{x}")).alias(x) for x in FIELDS])
    return out.withColumn("f", f).withColumn("ts_us", net.epoch_us(F.col("f.time"))).where(F.col("ts_us").isNotNull()).drop("o", "line")


def _endpoint(end: str) -> tuple[Column, Column, Column, Column]:
    """(pod id, role of a pod that the snapshot lacks, class of a reserved label, address) of an endpoint."""
    c = F.col(f"f.{end}")
    pod, ns = net.present(c["pod_name"]), net.present(c["namespace"])
    role = F.coalesce(net.present(F.get(c["workloads"], 0)["name"]), net.strip_pod_hash(pod))
    label = F.get(F.filter(c["labels"], lambda x: x.startswith("reserved:")), 0)
    return F.concat(F.lit("pod:"), ns, F.lit("/"), pod), role, F.when(label.isNotNull(), F.concat(F.lit("ext:"), net.endpoint_class(label))), net.present(c["ip"])


def with_endpoint(rows: DataFrame, addresses: DataFrame, end: str) -> DataFrame:
    """Adds {end}_id, {end}_type and {end}_role: a named pod, else the class of a reserved label, else what the address stands for."""
    pod, role, reserved, ip = _endpoint(end)
    out = resolve_ip(rows.withColumn(f"{end}_ip", F.when(pod.isNull() & reserved.isNull(), ip)), addresses, f"{end}_ip", f"{end}_by")
    return out.withColumns({
        f"{end}_id": F.coalesce(pod, reserved, F.col(f"{end}_by_id")), f"{end}_type": F.when(pod.isNotNull(), POD).when(reserved.isNotNull(), EXTERNAL).otherwise(F.col(f"{end}_by_type")), f"{end}_role": F.when(pod.isNotNull(), role),
    }).drop(f"{end}_ip", f"{end}_by_id", f"{end}_by_type")


def flow_events(lines: DataFrame, addresses: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """Events of (run_id, file, lineno, line). An answered query goes from the pod that asked, the answer's destination, to the name; a name record is never a flow."""
    c = F.col
    rows = parsed(lines)
    l4 = c("f.l4")
    proto = F.when(l4["TCP"].isNotNull(), "tcp").when(l4["UDP"].isNotNull(), "udp").when(l4["ICMPv4"].isNotNull() | l4["ICMPv6"].isNotNull(), "icmp")
    port = F.coalesce(l4["TCP"]["destination_port"], F.when(l4["TCP"].isNull(), l4["UDP"]["destination_port"]))
    query = net.present(c("f.l7.dns.query"))
    is_dns = query.isNotNull()
    keep_flow = keep(c("f.verdict"), proto, l4["TCP"]["flags"]["SYN"], l4["TCP"]["flags"]["ACK"], c("f.is_reply"), rules)
    rows = rows.where(F.when(is_dns, F.coalesce(c("f.l7.type") == "RESPONSE", F.lit(False))).otherwise(keep_flow))
    rows = with_endpoint(with_endpoint(rows, addresses, "source"), addresses, "destination")
    name = net.normalize_dns(query)
    common = [
        F.concat_ws(":", "run_id", "file", c("lineno").cast("string")).alias("event_id"), "run_id", (c("ts_us") / 1e6).alias("ts"), "ts_us", F.struct(F.lit(1), F.lit(0), c("file"), c("lineno")).alias("order"), "source_id", "source_type", "source_role", "destination_id", "destination_type", "destination_role",
    ]
    out = rows.select(
        *common, F.when(is_dns, DNS).otherwise(L4).alias("event_type"), F.when(is_dns, c("destination_id")).otherwise(c("source_id")).alias("src_id"), F.when(is_dns, c("destination_type")).otherwise(c("source_type")).alias("src_type"),
        F.when(is_dns, F.concat(F.lit("dns:"), name)).otherwise(c("destination_id")).alias("dst_id"), F.when(is_dns, DNSNAME).otherwise(c("destination_type")).alias("dst_type"),
        F.when(~is_dns, proto).alias("l4_proto"), F.when(~is_dns, port).alias("dst_port"), F.when(~is_dns, F.coalesce("f.verdict", F.lit("UNKNOWN"))).alias("verdict"), F.when(~is_dns, c("f.drop_reason_desc")).alias("drop_reason"),
        F.when(~is_dns, F.coalesce("f.is_reply", F.lit(False))).alias("is_reply"), F.when(is_dns, name).alias("dns_query"), F.when(is_dns, F.array_join(F.coalesce("f.l7.dns.qtypes", F.array().cast("array<string>")), ",")).alias("dns_qtypes"),
        F.when(is_dns, net.present(c("f.l7.dns.rcode"))).alias("dns_rcode"),
    )
    return out.withColumn("complete", c("src_id").isNotNull() & c("dst_id").isNotNull())
