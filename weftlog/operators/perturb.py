"""Synthetic mutations of event tables, for all runs at once.

Victims are drawn by a hash of run, candidate and seed, so a draw does not depend on the order of rows.  Each function returns
(events, victims); victims is (run_id, victim), and a run without a candidate has no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.schema import API, DNS, KUBEAPI, KUBEAPI_ID, POD, RPC, SERVICE

#: Fixed values of the injected events.
EXFIL_DOMAIN, EXFIL_QUERIES, BURST_CALLS, STEP_US = "drain-07.weft-probe.example", 20, 15, 100_000
SENSITIVE_CALLS = (("list", "secrets", None), ("create", "pods", None), ("get", "secrets", None), ("create", "pods", "exec"))


def drawn(candidates: DataFrame, column: str, seed: int, name: str) -> DataFrame:
    """One candidate of each run, the one of smallest hash."""
    key = F.struct(F.xxhash64("run_id", column, F.lit(seed)), F.col(column))
    return candidates.groupBy("run_id").agg(F.min(key).getField(column).alias(name))


def pods_in(events: DataFrame) -> DataFrame:
    """(run_id, pod): pods that are the source of an event."""
    return events.where(F.col("src_type") == POD).select("run_id", F.col("src_id").alias("pod")).distinct()


def services_not_called(events: DataFrame, entities: DataFrame, callers: DataFrame) -> DataFrame:
    """(run_id, service): services of a run that are no destination of the caller's calls. Calls resolved to pods do not mark their service."""
    services = entities.where(F.col("entity_type") == SERVICE).select("run_id", F.col("entity_id").alias("service"))
    calls = events.where((F.col("event_type") == RPC) & (F.col("src_type") == POD)).join(callers.select("run_id", F.col("victim").alias("src_id")), ["run_id", "src_id"], "left_semi")
    return services.join(callers.select("run_id"), "run_id", "left_semi").join(calls.select("run_id", F.col("dst_id").alias("service")), ["run_id", "service"], "left_anti")


def retargeted(events: DataFrame, targets: DataFrame) -> DataFrame:
    """All calls of a run's victim go to its target; ``targets`` is (run_id, victim, target), a null target changes nothing."""
    out = events.join(targets.select("run_id", "victim", "target"), "run_id", "left")
    hit = F.coalesce((F.col("event_type") == RPC) & (F.col("src_id") == F.col("victim")) & F.col("target").isNotNull(), F.lit(False))
    new = lambda c, value: F.when(hit, value).otherwise(F.col(c))
    out = out.withColumns({"dst_id": new("dst_id", F.col("target")), "dst_type": new("dst_type", F.lit(SERVICE)), "dst_svc_id": new("dst_svc_id", F.col("target"))})
    return out.drop("victim", "target")


def rewire(events: DataFrame, entities: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """A pod's calls go to a service that it never calls."""
    callers = events.where((F.col("event_type") == RPC) & (F.col("src_type") == POD)).select("run_id", F.col("src_id").alias("pod")).distinct()
    victims = drawn(callers, "pod", seed, "victim")
    targets = drawn(services_not_called(events, entities, victims), "service", seed + 1, "target")
    return retargeted(events, victims.join(targets, "run_id", "left")), victims


def injected(events: DataFrame, victims: DataFrame, copies: int, values: dict[str, Column]) -> DataFrame:
    """``events`` and, for each victim, ``copies`` events STEP_US apart from its first event on; ``values`` may use i, victim and t0."""
    first = events.join(victims, "run_id").where(F.col("src_id") == F.col("victim")).groupBy("run_id", "victim").agg(F.min("ts_us").alias("t0"))
    rows = first.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("ts_us", F.col("t0") + F.col("i") * STEP_US)
    fixed = {"ts": F.col("ts_us") / 1e6, "src_id": F.col("victim"), "src_type": F.lit(POD), "ord": (F.lit(1 << 40) + F.col("i")).cast("long")}
    rows = rows.withColumns(fixed | values).drop("victim", "t0", "i")
    kinds = dict(events.dtypes)
    rows = rows.select(*[F.col(c).cast(kinds[c]) for c in rows.columns if c in kinds])
    return events.unionByName(rows, allowMissingColumns=True)


def dns_exfil(events: DataFrame, entities: DataFrame, seed: int = 17, victims: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries from a pod for an external name never seen before."""
    victims = drawn(pods_in(events), "pod", seed, "victim") if victims is None else victims
    values = {
        "event_id": F.concat(F.lit("perturb:dns:"), F.col("i")), "event_type": F.lit(DNS), "dst_id": F.lit(f"dns:{EXFIL_DOMAIN}"), "dst_type": F.lit("DNSName"),
        "dns_query": F.lit(EXFIL_DOMAIN), "dns_qtypes": F.lit("A"), "dns_rcode": F.lit("0"),
    }
    return injected(events, victims, EXFIL_QUERIES, values), victims


def swapped(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sources ``victim`` and ``other`` of a run change places; destinations stay."""
    out = events.join(pairs.select("run_id", "victim", "other"), "run_id", "left")
    src = F.when(F.col("src_id") == F.col("victim"), F.coalesce("other", "src_id")).when(F.col("src_id") == F.col("other"), F.col("victim")).otherwise(F.col("src_id"))
    return out.withColumn("src_id", src).drop("victim", "other")


def sentence_swap(events: DataFrame, entities: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Two pods change places as sources; runs with fewer than two pods stay as they are."""
    pods = pods_in(events)
    victims = drawn(pods, "pod", seed, "victim")
    others = drawn(pods.join(victims.select("run_id", F.col("victim").alias("pod")), ["run_id", "pod"], "left_anti"), "pod", seed + 1, "other")
    pairs = victims.join(others, "run_id")
    return swapped(events, pairs), pairs.select("run_id", "victim")


def quiet_pods(events: DataFrame) -> DataFrame:
    """(run_id, pod): pods that never call the API server."""
    calls = events.where(F.col("event_type") == API).select("run_id", F.col("src_id").alias("pod"))
    return pods_in(events).join(calls, ["run_id", "pod"], "left_anti")


def api_burst(events: DataFrame, entities: DataFrame, seed: int = 17, victims: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sensitive API calls from a pod that never made one."""
    victims = drawn(quiet_pods(events), "pod", seed, "victim") if victims is None else victims
    calls = F.array(*[F.struct(F.lit(v).alias("verb"), F.lit(r).alias("res"), F.lit(s).cast("string").alias("sub")) for v, r, s in SENSITIVE_CALLS])
    call = F.get(calls, (F.col("i") % len(SENSITIVE_CALLS)).cast("int"))
    values = {
        "event_id": F.concat(F.lit("perturb:api:"), F.col("i")), "event_type": F.lit(API), "dst_id": F.lit(KUBEAPI_ID), "dst_type": F.lit(KUBEAPI), "k8s_verb": call["verb"],
        "k8s_resource": call["res"], "k8s_subresource": call["sub"], "k8s_user_type": F.lit("sa"), "k8s_status_code": F.lit(200),
    }
    return injected(events, victims, BURST_CALLS, values), victims


PERTURBATIONS: dict[str, Callable] = {"rewire": rewire, "dns_exfil": dns_exfil, "sentence_swap": sentence_swap, "api_burst": api_burst}
