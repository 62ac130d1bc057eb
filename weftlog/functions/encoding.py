"""Events and ages as feature vectors, built from column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlog.functions.net import present
from weftlog.functions.tokens import PORT_CLASSES, dns_token, first_qtype, flags, port_class, status_class, template_path
from weftlog.schema import API, DNS, EVENT_TYPES, L4, RPC

OOV = "<oov>"
#: Categorical slots. Their order is the feature layout; fixed values.
PROTOCOLS = ("http", "grpc", "na")
METHODS = ("get", "post", "put", "delete", "patch", "head", "options", "connect", "other", "na")
STATUS = ("na", "1xx", "2xx", "3xx", "4xx", "5xx")
GRPC_STATUS = ("na", "ok", "err")
RESPONSE_FLAGS = ("uh", "uf", "uo", "nr", "urx", "nc", "dc", "lr", "ut", "rl", "other")
L4_PROTOCOLS = ("tcp", "udp", "icmp", "na")
PORTS = (*sorted(set(PORT_CLASSES.values())), "system", "registered", "ephemeral", "na")
VERDICTS = ("forwarded", "dropped", "error", "audit", "other", "na")
DROP_REASONS = ("na", "policy_denied", "other")
TRISTATE = ("true", "false", "na")
QTYPES = ("a", "aaaa", "cname", "srv", "ptr", "txt", "mx", "ns", "other", "na")
DNS_DESTINATIONS = ("cluster", "ext", "na")
RCODES = ("noerror", "nxdomain", "servfail", "refused", "other", "na")
RCODE_NUMBERS = {"0": "noerror", "2": "servfail", "3": "nxdomain", "5": "refused"}
VERBS = ("get", "list", "watch", "create", "update", "patch", "delete", "deletecollection", "other", "na")
SUBRESOURCES = ("na", "status", "exec", "log", "attach", "portforward", "other")
USER_TYPES = ("sa", "node", "user", "na")
SCALED = ("duration_ms", "request_bytes", "response_bytes")


def place(value: Column, slots: tuple[str, ...] | list[str]) -> Column:
    """0-based place of a value among slots; -1 if absent."""
    return (F.array_position(F.array(*[F.lit(s) for s in slots]), value) - 1).cast("int")


def slot(value: Column, slots: tuple[str, ...]) -> Column:
    """Place of a lower-cased value; missing is na, and what is not listed is other, or na where there is no other."""
    at = place(F.lower(F.coalesce(present(value), F.lit("na"))), slots)
    return F.when(at >= 0, at).otherwise(slots.index("other") if "other" in slots else slots.index("na"))


def one_hot(at: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == at, 1.0).otherwise(0.0))


def entry(at: Column | int, value: Column | float = 1.0) -> Column:
    """A place of a sparse vector and its value."""
    at = at if isinstance(at, Column) else F.lit(at)
    value = value if isinstance(value, Column) else F.lit(value)
    return F.struct(at.cast("int").alias("i"), value.cast("double").alias("v"))


def dense(entries: Column, width: int) -> Column:
    """A dense array from entries at distinct places, in one pass over them."""
    none = F.array().cast("array<double>")
    step = lambda a, e: F.struct(F.concat(a["x"], F.array_repeat(F.lit(0.0), e["i"] - a["n"]), F.array(e["v"])).alias("x"), (e["i"] + 1).alias("n"))
    finish = lambda a: F.concat(a["x"], F.array_repeat(F.lit(0.0), F.lit(width) - a["n"]))
    return F.aggregate(F.array_sort(entries), F.struct(none.alias("x"), F.lit(0).alias("n")), step, finish)


def positional_encoding(position: Column, width: int) -> Column:
    """Sines at even places and cosines at odd ones, of wavelengths that grow with the place."""
    angle = lambda i: position / F.pow(F.lit(10000.0), (2 * F.floor(i / 2)) / F.lit(float(width)))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))


def scaled(value: Column, mean: float, deviation: float) -> Column:
    """Standardised log(1 + value), within 5 deviations; a missing value is 0."""
    z = (F.log1p(F.greatest(value.cast("double"), F.lit(0.0))) - mean) / deviation
    return F.coalesce(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z)), F.lit(0.0))


@dataclass
class FeatureSpec:
    """Vocabularies and scalers fitted on training events; it fixes every width."""

    paths: list[str] = field(default_factory=lambda: [OOV])
    names: list[str] = field(default_factory=lambda: [OOV])
    resources: list[str] = field(default_factory=lambda: [OOV])
    scalers: dict[str, tuple[float, float]] = field(default_factory=lambda: {f: (0.0, 1.0) for f in SCALED})
    time_width: int = 16
    path_width: int = 64
    name_width: int = 32
    resource_width: int = 32

    @property
    def widths(self) -> dict[str, int]:
        return {
            "shared": len(EVENT_TYPES) + self.time_width + 1,
            RPC: len(PROTOCOLS) + len(METHODS) + self.path_width + len(STATUS) + len(GRPC_STATUS) + len(RESPONSE_FLAGS) + len(SCALED) + 1,
            L4: len(L4_PROTOCOLS) + len(PORTS) + len(VERDICTS) + len(DROP_REASONS) + len(TRISTATE),
            DNS: len(QTYPES) + len(DNS_DESTINATIONS) + self.name_width + len(RCODES),
            API: len(VERBS) + self.resource_width + len(SUBRESOURCES) + len(USER_TYPES) + len(STATUS),
        }

    @property
    def event_width(self) -> int:
        return sum(self.widths.values())

    @property
    def entity_width(self) -> int:
        return 1 + self.time_width


class _Block:
    """Collects the entries of one block, field by field."""

    def __init__(self, offset: int):
        self.at, self.entries = offset, []

    def hot(self, place_: Column, width: int) -> None:
        self.entries.append(entry(place_ + self.at))
        self.at += width

    def of(self, value: Column, slots: tuple[str, ...]) -> None:
        self.hot(slot(value, slots), len(slots))

    def known(self, value: Column, vocabulary: list[str], width: int) -> None:
        self.hot(F.greatest(place(value, vocabulary), F.lit(0)), width)

    def number(self, value: Column) -> None:
        self.entries.append(entry(self.at, value))
        self.at += 1


def event_entries(spec: FeatureSpec, order: Column, relative_time: Column, strip_verdict: bool = False) -> Column:
    """An event's vector as (place, value) entries, from the behaviour columns, its order in the window and its time relative to it.

    The shared block comes first, then one block for each event type, of which only the event's own is filled.
    """
    c, widths = F.col, spec.widths
    offsets, at = {}, widths["shared"]
    for kind in (RPC, L4, DNS, API):
        offsets[kind] = at
        at += widths[kind]

    rpc = _Block(offsets[RPC])
    rpc.of(c("protocol"), PROTOCOLS)
    rpc.of(c("method"), METHODS)
    rpc.known(template_path(c("path"), c("protocol")), spec.paths, spec.path_width)
    rpc.of(status_class(c("status_code")), STATUS)
    rpc.hot(F.when(c("grpc_status").isNull(), 0).when(c("grpc_status") == 0, 1).otherwise(2), len(GRPC_STATUS))
    flag_at = rpc.at
    rpc.at += len(RESPONSE_FLAGS)
    for f in SCALED:
        rpc.number(scaled(c(f), *spec.scalers[f]))
    rpc.number(F.when(c("reporter_views") == 2, 1.0).otherwise(0.0))
    flag_entries = F.transform(F.array_distinct(F.transform(flags(c("response_flags")), lambda f: slot(f, RESPONSE_FLAGS))), lambda i: entry(i + flag_at))

    flow = _Block(offsets[L4])
    flow.of(c("l4_proto"), L4_PROTOCOLS)
    flow.of(port_class(c("dst_port")), PORTS)
    if strip_verdict:
        flow.at += len(VERDICTS) + len(DROP_REASONS)
    else:
        flow.of(c("verdict"), VERDICTS)
        flow.hot(F.when(present(c("drop_reason")).isNull(), 0).when(F.upper("drop_reason") == "POLICY_DENIED", 1).otherwise(2), len(DROP_REASONS))
    flow.of(c("is_reply").cast("string"), TRISTATE)

    dns = _Block(offsets[DNS])
    token = dns_token(c("dns_query"))
    external = token.startswith("dst:ext:")
    dns.of(first_qtype(c("dns_qtypes")), QTYPES)
    dns.hot(F.when(token == "dst:cluster", 0).when(external, 1).otherwise(2), len(DNS_DESTINATIONS))
    name = entry(F.greatest(place(F.substr(token, F.lit(len("dst:ext:") + 1)), spec.names), F.lit(0)) + dns.at)
    dns.at += spec.name_width
    rcode = F.lower(F.trim(F.coalesce(present(c("dns_rcode")), F.lit("na"))))
    numbers = F.create_map(*[F.lit(x) for pair in RCODE_NUMBERS.items() for x in pair])
    dns.of(F.coalesce(F.try_element_at(numbers, rcode), rcode), RCODES)

    api = _Block(offsets[API])
    api.of(c("k8s_verb"), VERBS)
    api.known(F.lower(F.coalesce(present(c("k8s_resource")), F.lit("na"))), spec.resources, spec.resource_width)
    api.of(c("k8s_subresource"), SUBRESOURCES)
    api.of(c("k8s_user_type"), USER_TYPES)
    api.of(status_class(c("k8s_status_code")), STATUS)

    kinds = len(EVENT_TYPES)
    none = F.array().cast("array<struct<i:int,v:double>>")
    type_entry = F.when(place(c("event_type"), EVENT_TYPES) >= 0, F.array(entry(place(c("event_type"), EVENT_TYPES)))).otherwise(none)
    time = F.transform(positional_encoding(order, spec.time_width), lambda v, i: entry(i + kinds, v))
    own = (
        F.when(c("event_type") == RPC, F.concat(F.array(*rpc.entries), flag_entries)).when(c("event_type") == L4, F.array(*flow.entries))
        .when(c("event_type") == DNS, F.concat(F.array(*dns.entries), F.when(external, F.array(name)).otherwise(none))).when(c("event_type") == API, F.array(*api.entries)).otherwise(none)
    )
    return F.concat(type_entry, time, F.array(entry(kinds + spec.time_width, relative_time)), own)


def event_features(spec: FeatureSpec, order: Column, relative_time: Column, strip_verdict: bool = False) -> Column:
    """``event_entries`` as a dense array."""
    return dense(event_entries(spec, order, relative_time, strip_verdict), spec.event_width)


def entity_features(spec: FeatureSpec, age: Column) -> Column:
    """A bias and the age of an entity's copy, nothing else."""
    return F.concat(F.array(F.lit(1.0)), positional_encoding(age, spec.time_width))
