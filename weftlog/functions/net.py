"""Names and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 4 to 11 lower-case letters and digits, with a digit among them.
_HASH = "(?=[a-z]*[0-9])[a-z0-9]{4,11}"


def present(c: Column) -> Column:
    """An empty string counts as missing."""
    return F.when(c != "", c)


def is_hash(segment: Column) -> Column:
    """Whether a name's segment looks like a generated suffix."""
    return segment.rlike(f"^{_HASH}$")


def strip_pod_hash(name: Column) -> Column:
    """A pod's name without its one or two generated suffixes; something must stand before the last dash."""
    two, one = f"(?s)^(.*)-{_HASH}-{_HASH}$", f"(?s)^(.*)-{_HASH}$"
    return F.when(name.rlike(two), F.regexp_replace(name, two, "$1")).otherwise(F.regexp_replace(name, one, "$1"))


def normalize_dns(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\.+$", ""))


def upstream_direction(cluster: Column) -> Column:
    """outbound, inbound, or unknown unless the name has four parts."""
    parts = F.split(F.coalesce(cluster, F.lit("")), r"\|")
    first = F.get(parts, 0)
    return F.when((F.size(parts) >= 4) & first.isin("outbound", "inbound"), first).otherwise("unknown")


def upstream_service(cluster: Column) -> Column:
    """The service name of an upstream cluster of known direction."""
    fqdn = F.get(F.split(F.coalesce(cluster, F.lit("")), r"\|"), 3)
    return F.when(upstream_direction(cluster) != "unknown", normalize_dns(present(fqdn)))


def service_id(fqdn: Column) -> Column:
    """svc:<namespace>/<name> of a cluster-internal service name, else null."""
    parts = F.split(fqdn, r"\.")
    return F.when(F.get(parts, 2) == "svc", F.concat(F.lit("svc:"), F.get(parts, 1), F.lit("/"), F.get(parts, 0)))


def epoch_us(text: Column) -> Column:
    """Microseconds of an ISO time; null if it is none. Without an offset the session's zone holds."""
    return F.unix_micros(text.try_cast("timestamp"))


def rpc_protocol(user_agent: Column, path: Column, protocol: Column) -> Column:
    """grpc by its user agent, or over HTTP/2 by a dot in the first segment of the path; else http."""
    segment = F.regexp_extract(F.coalesce(path, F.lit("")), r"^/*([^/]*)", 1)
    grpc = F.coalesce(user_agent, F.lit("")).startswith("grpc") | (F.coalesce(protocol, F.lit("")).startswith("HTTP/2") & segment.contains("."))
    return F.when(grpc, "grpc").otherwise("http")


def host_of(address: Column) -> Column:
    """What stands before the last colon; null for an empty address."""
    return F.regexp_replace(present(address), ":[^:]*$", "")


def user_type(username: Column) -> Column:
    return F.when(username.startswith("system:serviceaccount:"), "sa").when(username.startswith("system:node:"), "node").otherwise("user")


def canonical_service(canonical_label: Column, app_label: Column, owner: Column, name: Column) -> Column:
    """The first of: canonical-name label, app label, owner without hashes, name without hashes."""
    return F.coalesce(present(canonical_label), present(app_label), present(strip_pod_hash(present(owner))), strip_pod_hash(name))


def endpoint_class(label: Column) -> Column:
    """External class of a reserved label. The three own classes are fixed values."""
    own = F.substring_index(label, "reserved:", -1)
    return F.when(own.isin("host", "remote-node", "kube-apiserver"), own).otherwise("world")
