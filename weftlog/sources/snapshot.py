"""Cluster snapshots: entities, owners, and which entity an address stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.functions import net
from weftlog.schema import EXTERNAL, POD, SERVICE
from weftlog.scratch import written
from weftlog.sources.files import documents

_OBJECTS = (
    "items array<struct<kind: string, metadata: struct<name: string, namespace: string, uid: string, labels: map<string,string>, ownerReferences: array<struct<kind: string, name: string>>>, "
    "spec: struct<nodeName: string, serviceAccountName: string, clusterIP: string, containers: array<struct<name: string>>>, status: struct<podIP: string>>>"
)
_NODES = "items array<struct<metadata: struct<name: string>, status: struct<addresses: array<struct<type: string, address: string>>>>>"


def objects(spark: SparkSession, root: str) -> DataFrame:
    """(run_dir, seq, kind, metadata, spec, status) of all objects; those at the end of a run come behind those at its start."""
    out = None
    for rank, name in enumerate(("objects.json", "objects_end.json")):
        parsed = documents(spark, root, f"k8s_snapshot/{name}").select("run_dir", F.from_json("text", _OBJECTS).alias("o"))
        items = parsed.select("run_dir", F.posexplode("o.items").alias("i", "item")).select("run_dir", (F.lit(rank * 1_000_000_000).cast("long") + F.col("i")).alias("seq"), "item.*")
        out = items if out is None else out.unionByName(items)
    return out


def node_addresses(spark: SparkSession, root: str) -> DataFrame:
    """(run_dir, ip) of nodes' internal addresses."""
    parsed = documents(spark, root, "k8s_snapshot/nodes.json").select("run_dir", F.explode(F.from_json("text", _NODES)["items"]).alias("n"))
    return parsed.select("run_dir", F.inline("n.status.addresses")).where("type = 'InternalIP'").select("run_dir", F.col("address").alias("ip")).distinct()


def deployments(objects_: DataFrame) -> DataFrame:
    """(run_id, owner, deployment): the deployment of each replica set by its name; the last one read counts."""
    refs = objects_.where("kind = 'ReplicaSet'").select("run_id", "seq", F.col("metadata.name").alias("owner"), F.posexplode("metadata.ownerReferences").alias("i", "ref")).where("ref.kind = 'Deployment'")
    return refs.groupBy("run_id", "owner").agg(F.max_by(F.col("ref.name"), F.struct("seq", "i")).alias("deployment"))


def with_workload(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Adds workload: the deployment behind a row's owner, or the owner itself."""
    return rows.join(owners, ["run_id", "owner"], "left").withColumn("workload", F.coalesce("deployment", "owner")).drop("deployment")


def snapshot_entities(objects_: DataFrame) -> DataFrame:
    """Pods and services as they were first seen, with seq."""
    pods = objects_.where("kind = 'Pod'").withColumn("owner", F.get(F.col("metadata.ownerReferences"), 0)["name"])
    pods = with_workload(pods, deployments(objects_))
    label = lambda name: F.try_element_at(F.col("metadata.labels"), F.lit(name))
    name, ns = F.coalesce("metadata.name", F.lit("")), F.coalesce("metadata.namespace", F.lit(""))
    pods = pods.select(
        "run_id", "seq", F.concat(F.lit("pod:"), ns, F.lit("/"), name).alias("entity_id"), F.lit(POD).alias("entity_type"), name.alias("name"), ns.alias("namespace"),
        net.canonical_service(label("service.istio.io/canonical-name"), label("app"), F.col("workload"), name).alias("canonical_service"), "workload",
        F.col("spec.nodeName").alias("node_name"), F.col("status.podIP").alias("pod_ip"), F.col("spec.serviceAccountName").alias("service_account"), F.col("metadata.uid").alias("uid"),
        F.coalesce(F.array_contains(F.col("spec.containers.name"), "istio-proxy"), F.lit(False)).alias("has_sidecar"),
    )
    services = objects_.where("kind = 'Service'").select(
        "run_id", "seq", F.concat(F.lit("svc:"), ns, F.lit("/"), name).alias("entity_id"), F.lit(SERVICE).alias("entity_type"), name.alias("name"), ns.alias("namespace"), name.alias("canonical_service"), F.col("metadata.uid").alias("uid")
    )
    return pods.unionByName(services, allowMissingColumns=True)


def first_by_rank(addresses: DataFrame) -> DataFrame:
    """(run_id, ip, entity_id, entity_type): the entry of smallest rank for each address.

    Written, so that its true size tells the planner that events need no shuffle to meet it; by address they would lie in few tasks.
    """
    best = addresses.groupBy("run_id", "ip").agg(F.min_by(F.struct("entity_id", "entity_type"), "rank").alias("e"))
    return written(best.select("run_id", "ip", "e.*"), "addresses")


def address_table(objects_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Addresses of pods, then services, then nodes, which stand for the host; of two pods with one address the later counts."""
    ns, name = F.coalesce("metadata.namespace", F.lit("")), F.coalesce("metadata.name", F.lit(""))
    entry = lambda kind, ip, what, rank: objects_.where(F.col("kind") == kind).select("run_id", ip.alias("ip"), F.concat(F.lit(what), ns, F.lit("/"), name).alias("entity_id"), F.lit(kind).alias("entity_type"), F.struct(F.lit(rank), -F.col("seq")).alias("rank"))
    pods, services = entry("Pod", F.col("status.podIP"), "pod:", 0), entry("Service", F.col("spec.clusterIP"), "svc:", 1)
    hosts = nodes.select("run_id", "ip", F.lit("ext:host").alias("entity_id"), F.lit(EXTERNAL).alias("entity_type"), F.struct(F.lit(2), F.lit(0).cast("long")).alias("rank"))
    return first_by_rank(pods.unionByName(services).unionByName(hosts).where("ip <> '' AND ip <> 'None'"))


def resolve_ip(rows: DataFrame, addresses: DataFrame, ip: str, prefix: str) -> DataFrame:
    """Adds {prefix}_id and {prefix}_type: what an address stands for; the outside world if nothing is known, null without address."""
    known = addresses.select("run_id", F.col("ip").alias(ip), F.col("entity_id").alias("_id"), F.col("entity_type").alias("_type"))
    out = rows.join(known, ["run_id", ip], "left")
    given = F.col(ip) != ""
    return out.withColumns({f"{prefix}_id": F.when(given, F.coalesce("_id", F.lit("ext:world"))), f"{prefix}_type": F.when(given, F.coalesce("_type", F.lit(EXTERNAL)))}).drop("_id", "_type")


def type_of_id(entity_id: Column) -> Column:
    """Entity type by the head of an id."""
    head = F.substring_index(entity_id, ":", 1)
    return F.when(head == "pod", POD).when(head == "svc", SERVICE).when(head == "dns", "DNSName").when(head == "ext", EXTERNAL).when(head == "kubeapi", "KubeAPI").when(head == "workload", "Workload")
