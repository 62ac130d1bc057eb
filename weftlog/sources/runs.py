"""Run directories: catalogue, ingest, and the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlog.functions import net
from weftlog.operators.splits import run_order
from weftlog.schema import DNSNAME, ENTITIES, EVENTS, EXTERNAL, INTERNAL, KUBEAPI, KUBEAPI_ID, POD, SERVICE, conform
from weftlog.scratch import written
from weftlog.sources import access, audit, flows, snapshot
from weftlog.sources.files import documents, numbered_lines
from weftlog.sources.ranges import ranged_lines

_META = "benchmark string, request string, run_id string, run_status int"
#: Columns of events that name entities.
NAMED = ("run_id", "src_id", "dst_id", "dst_svc_id", "source_id", "source_role", "destination_id", "destination_role", "also_ip")
LOGS, FLOWS, AUDIT = "istio/access_logs/*.log", "cilium/flows.jsonl", "audit/audit.jsonl"


def run_catalogue(spark: SparkSession, root: str, benchmarks: list[str] | None = None) -> DataFrame:
    """(run_dir, run_id, benchmark) of finished runs under the pattern ``root``; one row for each directory with meta.json."""
    meta = documents(spark, root, "meta.json").select("run_dir", F.from_json("text", _META).alias("m")).select("run_dir", "m.*")
    kept = meta.where(F.coalesce("run_status", F.lit(1)) == 0)
    if benchmarks:
        kept = kept.where(F.col("benchmark").isin(list(benchmarks)))
    return kept.select("run_dir", F.concat(F.col("benchmark"), F.lit("-"), F.col("request"), F.lit("_"), F.col("run_id")).alias("run_id"), "benchmark")


def ingest(
    spark: SparkSession, root: str, benchmarks: list[str] | None = None, rules: tuple[str, ...] = flows.RULES, drop_control_plane: bool = True, namespace: str = "default", pruned: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(events, entities) of all runs under ``root``, as one job over all of them.

    With ``pruned``, logs are read by byte ranges (``ranges.ranged_lines``), and those of other runs are never opened; the driver
    then holds the paths of the run directories.
    """
    runs, objects, logs, every, addresses = _parsed(spark, root, benchmarks, rules, drop_control_plane, namespace, pruned)
    every = written(every, "parsed")  # events and entities both need it, and logs are dear to parse
    return _numbered(every), known_entities(spark, runs, objects, logs, every, addresses)


def ingest_entities(
    spark: SparkSession, root: str, benchmarks: list[str] | None = None, rules: tuple[str, ...] = flows.RULES, drop_control_plane: bool = True, namespace: str = "default", pruned: bool = False
) -> DataFrame:
    """The entities that ``ingest`` gives, without the events: of these only whom they name is kept, each once."""
    runs, objects, logs, every, addresses = _parsed(spark, root, benchmarks, rules, drop_control_plane, namespace, pruned, ends=True)
    return known_entities(spark, runs, objects, logs, written(every.select(*NAMED).distinct(), "named"), addresses)


def ingest_events(
    spark: SparkSession, root: str, benchmarks: list[str] | None = None, rules: tuple[str, ...] = flows.RULES, drop_control_plane: bool = True, namespace: str = "default", pruned: bool = False
) -> DataFrame:
    """The events that ``ingest`` gives, where no entities are wanted: parsed ones are numbered as they come and not written first."""
    return _numbered(_parsed(spark, root, benchmarks, rules, drop_control_plane, namespace, pruned)[3])


def _numbered(every: DataFrame) -> DataFrame:
    """Complete events with ord; ties in time follow the order of ingest, and only events of equal time are numbered together."""
    ties = Window.partitionBy("run_id", "ts_us").orderBy("order")
    events = every.where("complete").withColumn("ord", F.row_number().over(ties).cast("long"))
    return conform(events, type(EVENTS)(EVENTS.fields + INTERNAL.fields))


def _parsed(spark: SparkSession, root: str, benchmarks: list[str] | None, rules: tuple[str, ...], drop_control_plane: bool, namespace: str, pruned: bool, ends: bool = False) -> tuple[DataFrame, ...]:
    """(runs, objects, logs, every, addresses) of what lies under ``root``; ``every`` are all parsed events, dropped ones included, with ``ends`` of calls only whom they name."""
    runs = written(run_catalogue(spark, root, benchmarks).select("run_dir", "run_id"), "runs")
    objects = snapshot.objects(spark, root).join(runs, "run_dir")
    addresses = snapshot.address_table(objects, snapshot.node_addresses(spark, root).join(runs, "run_dir"))
    dirs = [r.run_dir for r in runs.select("run_dir").collect()] if pruned else None
    lines = lambda name: ranged_lines(spark, root, name, dirs).join(runs, "run_dir") if pruned else numbered_lines(spark, root, name, runs)
    stem = F.regexp_extract("file", r"([^/]+)\.log$", 1)
    logs = lines(LOGS).withColumn("pod", F.concat(F.lit(f"pod:{namespace}/"), stem))
    calls = access.rpc_events(logs, addresses, ends=ends)
    streams = flows.flow_events(lines(FLOWS), addresses, rules)
    api = audit.api_events(lines(AUDIT), addresses, drop_control_plane)
    every = calls.withColumn("complete", F.lit(True)).unionByName(streams, allowMissingColumns=True).unionByName(api, allowMissingColumns=True)
    return runs, objects, logs, every, addresses


def known_entities(spark: SparkSession, runs: DataFrame, objects: DataFrame, logs: DataFrame, every: DataFrame, addresses: DataFrame) -> DataFrame:
    """One row for each entity of a run: the API server, the snapshot's, and whatever was named or resolved on the way, dropped events included."""
    c = F.col
    lit = lambda s: F.lit(s)
    own = runs.select("run_id", lit(KUBEAPI_ID).alias("entity_id"), lit(KUBEAPI).alias("entity_type"), lit("kube-apiserver").alias("name"), F.struct(lit(0), lit(0).cast("long")).alias("rank"))
    snap = snapshot.snapshot_entities(objects).withColumn("rank", F.struct(lit(1), c("seq"))).drop("seq")
    reporters = logs.select("run_id", c("pod").alias("entity_id")).distinct()
    name, ns = F.substring_index("entity_id", "/", -1), F.regexp_extract("entity_id", "^[a-z]+:([^/]*)/", 1)
    reporters = reporters.select("run_id", "entity_id", lit(POD).alias("entity_type"), name.alias("name"), ns.alias("namespace"), net.strip_pod_hash(name).alias("canonical_service"), F.struct(lit(2), lit(0).cast("long")).alias("rank"))
    # an outbound view's remote address is resolved too, although its event does not use it
    also = snapshot.resolve_ip(every.where("also_ip IS NOT NULL").select("run_id", "also_ip").distinct(), addresses, "also_ip", "x").select("run_id", c("x_id").alias("entity_id"), lit(None).cast("string").alias("role"))
    end = lambda i, role: F.struct(c(i).alias("entity_id"), role.alias("role"))
    none = lit(None).cast("string")
    ends = F.array(end("src_id", none), end("dst_id", none), end("dst_svc_id", none), end("source_id", c("source_role")), end("destination_id", c("destination_role")))
    named = every.select("run_id", F.inline(ends)).where("entity_id IS NOT NULL").distinct().unionByName(also)
    kind = snapshot.type_of_id(c("entity_id"))
    plain = F.regexp_replace("entity_id", "^[a-z]+:", "")
    named = named.select(
        "run_id", "entity_id", kind.alias("entity_type"), F.when(kind.isin(POD, SERVICE), name).otherwise(plain).alias("name"), F.when(kind.isin(POD, SERVICE), ns).alias("namespace"),
        F.when(kind == POD, F.coalesce("role", net.strip_pod_hash(name))).when(kind == SERVICE, name).alias("canonical_service"), F.struct(lit(3), F.when(c("role").isNull(), 1).otherwise(0).cast("long")).alias("rank"),
    ).where(kind.isin(POD, SERVICE, DNSNAME, EXTERNAL, KUBEAPI))
    rows = own.unionByName(snap, allowMissingColumns=True).unionByName(reporters, allowMissingColumns=True).unionByName(named, allowMissingColumns=True)
    fields = [f.name for f in ENTITIES if f.name not in ("run_id", "entity_id")]
    first = rows.groupBy("run_id", "entity_id").agg(F.min_by(F.struct(*fields), "rank").alias("e"))
    return conform(first.select("run_id", "entity_id", "e.*"), ENTITIES)


def write_events(events: DataFrame, out: str) -> None:
    events.write.mode("overwrite").partitionBy("run_id").parquet(f"{out}/events")


def write_tables(events: DataFrame, entities: DataFrame, out: str) -> None:
    """Both tables as Parquet, partitioned by run so that reading some runs reads no others."""
    write_events(events, out)
    entities.write.mode("overwrite").partitionBy("run_id").parquet(f"{out}/entities")


def load_events(spark: SparkSession, out: str, runs: list[str] | None = None) -> DataFrame:
    """Events of some runs, or of all."""
    return _loaded(spark, f"{out}/events", type(EVENTS)(EVENTS.fields + INTERNAL.fields), runs)


def load(spark: SparkSession, out: str, runs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, entities) of some runs, or of all."""
    return load_events(spark, out, runs), _loaded(spark, f"{out}/entities", ENTITIES, runs)


def _loaded(spark: SparkSession, path: str, schema, runs: list[str] | None) -> DataFrame:
    table = conform(spark.read.parquet(path), schema)
    return table if runs is None else table.where(F.col("run_id").isin(list(runs)))


def list_runs(spark: SparkSession, out: str, benchmarks: list[str] | None = None) -> list[str]:
    """Ids of ingested runs in order of time; the benchmark is the text before the first dash."""
    ids = spark.read.parquet(f"{out}/events").select("run_id").distinct()
    if benchmarks:
        ids = ids.where(F.substring_index("run_id", "-", 1).isin(list(benchmarks)))
    return [r.run_id for r in run_order(ids).orderBy("place").collect()]


