"""Interaction graphs of windows as node and edge tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.schema import RPC, WORKLOAD
from weftlog.scratch import written


def known_entities(entities: DataFrame, workloads: bool = False) -> DataFrame:
    return entities if workloads else entities.where(F.col("entity_type") != WORKLOAD)


def incident_nodes(placed: DataFrame, entities: DataFrame, workloads: bool = False) -> DataFrame:
    """(run_id, w_idx, pos, entity_id, entity_type, canonical_service, namespace) of each known entity with an event in a window."""
    ends = F.filter(F.array("src_id", "dst_id", F.col("dst_svc_id")), lambda e: e.isNotNull() & (e != ""))
    seen = placed.select("run_id", "w_idx", "pos", F.explode(ends).alias("entity_id")).distinct()
    meta = known_entities(entities, workloads).select("run_id", "entity_id", "entity_type", "canonical_service", "namespace")
    return seen.join(meta, ["run_id", "entity_id"]).select("run_id", "w_idx", "pos", "entity_id", "entity_type", "canonical_service", "namespace")


def event_pairs(placed: DataFrame) -> DataFrame:
    """(run_id, w_idx, pos, src, dst) of each event: source to destination, and for calls to the service in front of it."""
    c = F.col
    service = F.when((c("event_type") == RPC) & (c("dst_svc_id") != "") & ~c("dst_svc_id").eqNullSafe(c("dst_id")), c("dst_svc_id"))
    ends = F.filter(F.array("dst_id", service), lambda e: e.isNotNull())
    return placed.select("run_id", "w_idx", "pos", c("src_id").alias("src"), F.explode(ends).alias("dst"))


def window_edges(placed: DataFrame, entities: DataFrame, reverse: bool = True, workloads: bool = False) -> DataFrame:
    """Distinct edges between known entities of a window, without loops, and their reverses.

    Pairs are made distinct before they meet the entities, so that repeated calls cost one row each; with reverses, a pair is one
    row whichever way its calls went, until both ways are given out at the end.
    """
    pairs = event_pairs(placed).where("src <> dst")
    if reverse:
        pairs = pairs.select("run_id", "w_idx", "pos", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    pairs = pairs.distinct()
    ids = known_entities(entities, workloads).select("run_id", "entity_id")
    for end in ("src", "dst"):
        pairs = pairs.join(ids.withColumnRenamed("entity_id", end), ["run_id", end], "left_semi")
    if not reverse:
        return pairs.select("run_id", "w_idx", "pos", "src", "dst")
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.select("run_id", "w_idx", "pos", F.inline(ways))


def with_reverse(edges: DataFrame) -> DataFrame:
    keys = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def mean_vector(column: str):
    """Mean of array columns, pre-aggregated in each task."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(column))))


#: Places of a vector that are added up as columns; longer ones go to Spark's summarizer.
COLUMNS = 90


def mean_vectors(rows: DataFrame, keys: list[str], column: str, width: int, count: str | None = None) -> DataFrame:
    """(keys, column): mean of arrays of ``width`` places for each key, with ``count`` also how many there were.

    Each place is a column of its own, so sums are kept in Spark's hash aggregation, which neither sorts nor serialises vectors.
    """
    more = [] if count is None else [count]
    n = F.count(F.lit(1)).alias("_n" if count is None else count)
    if width > COLUMNS:
        return rows.groupBy(*keys).agg(mean_vector(column).alias(column), n).select(*keys, column, *more)
    sums = rows.groupBy(*keys).agg(*[F.sum(F.get(column, F.lit(i))).alias(f"_s{i}") for i in range(width)], n)
    return sums.select(*keys, F.array(*[F.col(f"_s{i}") / F.col(count or "_n") for i in range(width)]).alias(column), *more)


def neighbour_mean(edges: DataFrame, features: DataFrame, keys: list[str], node: str = "entity_id", column: str = "x", vectors: DataFrame | None = None, number: str = "vec_id") -> DataFrame:
    """Mean of the ``column`` arrays of each destination's sources: (keys, node, column).

    Where ``features`` hold only the ``number`` of a vector in the table ``vectors``, edges are dealt by destination first and meet the
    vectors there, so that only numbers are shuffled.
    """
    sources = features.select(*keys, F.col(node).alias("src"), column if vectors is None else number)
    heard = edges.join(sources, [*keys, "src"])
    if vectors is not None:
        heard = heard.select(*keys, "dst", number).repartition(*keys, "dst").join(vectors.select(number, column), number)
    return heard.groupBy(*keys, "dst").agg(mean_vector(column).alias(column)).withColumnRenamed("dst", node)


def propagated(edges: DataFrame, features: DataFrame, keys: list[str], hops: int = 2, node: str = "entity_id", column: str = "x", width: int = 64) -> DataFrame:
    """Each node's own vector followed by the means over its neighbourhoods of 1 to ``hops`` steps; without neighbours, zeros.

    What several hops use is written once, and a hop's table holds the vectors of all hops before.  Rows are sorted by a hash of their
    keys before the keys themselves, which begin alike and are long to compare.
    """
    at = lambda end: F.xxhash64(*keys, end)
    edges, now = written(edges.withColumn("_at", at("src")), "edges"), written(features.withColumn("_at", at(node)), "nodes")
    none = F.array_repeat(F.lit(0.0), width)
    for hop in range(1, hops + 1):
        before, after = column if hop == 1 else f"{column}{hop - 1}", f"{column}{hop}"
        heard = edges.join(now.select("_at", *keys, F.col(node).alias("src"), F.col(before).alias(after)), ["_at", *keys, "src"])
        mean = mean_vectors(heard, [*keys, "dst"], after, width).withColumnRenamed("dst", node).withColumn("_at", at(node))
        now = now.join(mean, ["_at", *keys, node], "left").withColumn(after, F.coalesce(after, none))
        if hop < hops:
            now = written(now, "hop")
    return now.drop("_at")
