"""Behaviour tokens of events as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlog.functions.net import present
from weftlog.schema import API, DNS, L4, RPC

#: Ports with a class of their own. Fixed values.
PORT_CLASSES = {
    53: "dns", 80: "http", 443: "https", 3000: "http-alt", 8080: "http-alt", 5000: "grpc", 7000: "grpc", 7070: "grpc", 8000: "http-alt", 6379: "redis", 3306: "mysql",
    5432: "postgres", 9092: "kafka", 27017: "mongo", 11211: "memcached", 6443: "kubeapi", 9090: "prom", 15021: "istio-health", 15090: "istio-metrics", 15012: "istio-xds", 15017: "istio-webhook",
}
#: Names under these are inside the cluster. Fixed values.
INTERNAL_SUFFIXES = (".svc.cluster.local", ".cluster.local", ".svc", ".local", ".in-addr.arpa", ".cluster")
_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _or(c: Column, default: str) -> Column:
    return F.coalesce(present(c), F.lit(default))


def port_class(port: Column) -> Column:
    port = port.cast("int")
    known = F.create_map(*[F.lit(x) for pair in PORT_CLASSES.items() for x in pair])
    by_range = F.when(port < 1024, "system").when(port < 49152, "registered").otherwise("ephemeral")
    return F.when(port.isNull(), "na").otherwise(F.coalesce(F.try_element_at(known, port), by_range))


def status_class(code: Column) -> Column:
    """First digit and xx; null and 0 are na."""
    return F.when(code.isNull() | (code == 0), "na").otherwise(F.concat(F.floor(code / 100).cast("string"), F.lit("xx")))


def is_id_like(segment: Column) -> Column:
    """Whether a lower-case path segment stands for one thing among many: a number, an UUID, long hex, or mostly digits."""
    digits = F.length(F.regexp_replace(segment, "[^0-9]", ""))
    mixed = segment.rlike("^[a-z0-9]{8,}$") & (digits >= 1)
    return segment.rlike("^[0-9]+$") | segment.rlike(_UUID) | segment.rlike("^[0-9a-f]{8,}$") | mixed | ((F.length(segment) >= 6) & (digits * 2 > F.length(segment)))


def template_path(path: Column, protocol: Column) -> Column:
    """A path with at most four segments and without ids; of a gRPC path only the method, as the service names the callee."""
    cut = F.lower(F.substring_index(F.substring_index(path, "?", 1), "#", 1))
    parts = F.filter(F.split(cut, "/"), lambda s: s != "")
    segments = F.transform(F.slice(F.split(cut, "/"), 2, 4), lambda s: F.when(is_id_like(s), "*").otherwise(s))
    method = F.concat(F.lit("/*/"), F.get(parts, 1))
    grpc = (protocol == "grpc") & (F.size(parts) == 2) & F.get(parts, 0).contains(".")
    return F.when(path.isNull() | (path == ""), "/").when(grpc, method).otherwise(F.concat(F.lit("/"), F.array_join(segments, "/")))


def dns_token(name: Column) -> Column:
    """dst:na, dst:cluster, or dst:ext: with the last two labels."""
    name_ = F.lower(F.regexp_replace(present(name), r"\.+$", ""))
    inside = ~name_.contains(".")
    for suffix in INTERNAL_SUFFIXES:
        inside = inside | name_.endswith(suffix)
    return F.when(name_.isNull(), "dst:na").when(inside, "dst:cluster").otherwise(F.concat(F.lit("dst:ext:"), F.substring_index(name_, ".", -2)))


def verdict_token(verdict: Column) -> Column:
    return F.lower(_or(verdict, "na"))


def flags(response_flags: Column) -> Column:
    """The response flags that are set, lower-case."""
    each = F.transform(F.split(_or(response_flags, "-"), ","), lambda f: F.lower(F.trim(f)))
    return F.filter(each, lambda f: (f != "") & (f != "-"))


def first_qtype(qtypes: Column) -> Column:
    return _or(F.lower(F.trim(F.get(F.split(F.coalesce(qtypes, F.lit("")), ","), 0))), "na")


def event_tokens(direction: Column, strip_verdict: bool = False) -> Column:
    """Tokens of an event as an endpoint sees it (``direction`` is out or in), from the behaviour columns alone."""
    c = F.col
    say = lambda head, value: F.concat(F.lit(head), value)
    rpc = F.concat(
        F.array(say("rpc:", direction), say("proto:", _or(c("protocol"), "http")), say("m:", F.lower(_or(c("method"), "na"))), say("p:", template_path(c("path"), c("protocol"))), say("st:", status_class(c("status_code")))),
        F.transform(flags(c("response_flags")), lambda f: say("fl:", f)),
    )
    flow = [say("flow:", direction), say("proto:", _or(c("l4_proto"), "na")), say("port:", port_class(c("dst_port")))]
    if not strip_verdict:
        flow.append(say("v:", verdict_token(c("verdict"))))
    qt, rc = say("qt:", first_qtype(c("dns_qtypes"))), say("rc:", F.lower(_or(c("dns_rcode"), "na")))
    # the queried name's own view must not hold its name
    dns = F.when(direction == "out", F.array(F.lit("dns:q"), qt, dns_token(c("dns_query")), rc)).otherwise(F.array(F.lit("dns:in"), qt, rc))
    resource = F.concat(F.lower(_or(c("k8s_resource"), "na")), F.coalesce(say("/", F.lower(present(c("k8s_subresource")))), F.lit("")))
    api = F.array(say("api:", direction), say("verb:", F.lower(_or(c("k8s_verb"), "na"))), say("res:", resource), say("ut:", _or(c("k8s_user_type"), "na")), say("st:", status_class(c("k8s_status_code"))))
    kind = c("event_type")
    return F.when(kind == RPC, rpc).when(kind == L4, F.array(*flow)).when(kind == DNS, dns).when(kind == API, api).otherwise(F.array().cast("array<string>"))


def token_namespace(token: Column) -> Column:
    """What stands before the first colon; external names have a namespace of their own, and an empty one is misc."""
    return F.when(token.startswith("dst:ext:"), "dst-ext").otherwise(_or(F.substring_index(token, ":", 1), "misc"))


def unknown_token(token: Column) -> Column:
    """The bucket that stands for rare tokens of a namespace."""
    return F.concat(F.lit("unk:"), token_namespace(token))
