"""Memory graphs: entity copies and event nodes over the last windows, with typed edges.

Nodes and edges inside a window do not depend on which window is newest, so they are built once by position;
``in_memory`` then repeats them for each newest window that remembers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weftlog.operators.graphs import known_entities
from weftlog.operators.windows import memory_members
from weftlog.schema import DNS, L4, RPC
from weftlog.scratch import written

#: Microseconds of a window that are ordered in one task.
SLOT = 300_000_000
SPATIAL = ("src_of", "rev_src_of", "dst_of", "rev_dst_of")
TEMPORAL = ("follows_src", "follows_dst", "recurs")


def must_keep() -> Column:
    """Flows with a verdict other than forwarded."""
    return F.coalesce((F.col("event_type") == L4) & F.col("verdict").isNotNull() & (F.col("verdict") != "FORWARDED"), F.lit(False))


def cap_events(placed: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` events of a window: those that must be kept, all of them, and of the rest an even sample, ends included.

    Rows are counted by slot of a window first; the sample's places then follow from a rank inside the slot.
    """
    keys, slot = ["run_id", "pos"], ["run_id", "pos", "must", "slot"]
    # windows are cut into slots of time, so that no task orders a whole window; the counts are written, and their true size tells the planner how to join them
    marked = placed.withColumns({"must": must_keep(), "slot": F.floor(F.col("ts_us") / SLOT)})
    sizes = marked.groupBy(*slot).agg(F.count(F.lit(1)).alias("s"))
    over = Window.partitionBy(*keys)
    counts = sizes.select(
        *slot, (F.sum("s").over(Window.partitionBy(*keys, "must").orderBy("slot")) - F.col("s")).alias("before"), F.sum("s").over(over).alias("n"), F.sum(F.when(F.col("must"), F.col("s")).otherwise(0)).over(over).alias("n_must"),
    )
    counts = written(counts, "window-counts")
    ranked = marked.join(counts, slot).withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy(*slot).orderBy("ts_us", "ord")) - 1)
    rest, room = F.col("n") - F.col("n_must"), F.greatest(F.lit(cap) - F.col("n_must"), F.lit(0))
    # the i-th row is in the sample if some j of 0 .. room - 1 steps to it; the last step is exact
    step = (rest - 1) / (room - 1)
    j = F.ceil(F.col("i") / step)
    lands = lambda j: (j >= 0) & (j < room - 1) & (F.floor(j * step) == F.col("i"))
    sampled = F.when(room == 0, False).when(room == 1, F.col("i") == 0).when(rest <= room, True).otherwise((F.col("i") == rest - 1) | lands(j) | lands(j - 1) | lands(j + 1))
    return ranked.where((F.col("n") <= cap) | F.col("must") | sampled).drop("must", "slot", "before", "n", "n_must", "i")


def event_nodes(capped: DataFrame, width_us: int) -> DataFrame:
    """Events with order (0-based, by time and event id as text) and relative time in their window."""
    order = F.row_number().over(Window.partitionBy("run_id", "pos").orderBy("ts_us", "event_id")) - 1
    return capped.withColumns({"order": order, "rel_time": (F.col("ts_us") - F.col("t0_us")) / F.lit(float(width_us))})


def incidence(nodes: DataFrame, entities: DataFrame, workloads: bool = False) -> DataFrame:
    """(run_id, pos, event_id, event_type, entity_id, role) of events and the known entities at their ends; a call's service has the role dst."""
    c = F.col
    service = F.when((c("event_type") == RPC) & (c("dst_svc_id") != "") & ~c("dst_svc_id").eqNullSafe(c("dst_id")), c("dst_svc_id"))
    end = lambda who, role: F.struct(who.alias("entity_id"), F.lit(role).alias("role"))
    ends = F.filter(F.array(end(c("src_id"), "src"), end(c("dst_id"), "dst"), end(service, "dst")), lambda e: e["entity_id"].isNotNull())
    rows = nodes.select("run_id", "pos", "event_id", "event_type", F.inline(ends))
    return rows.join(known_entities(entities, workloads).select("run_id", "entity_id"), ["run_id", "entity_id"], "left_semi")


def entity_copies(incident: DataFrame) -> DataFrame:
    """One copy of an entity for each window that it appears in."""
    return incident.select("run_id", "pos", "entity_id").distinct()


def spatial_edges(incident: DataFrame) -> DataFrame:
    """(run_id, pos, edge_type, event_id, entity_id); a queried name gets no message back from its own query."""
    kinds = F.when(F.col("role") == "src", F.array(F.lit("src_of"), F.lit("rev_src_of"))).when(F.col("event_type") == DNS, F.array(F.lit("dst_of"))).otherwise(F.array(F.lit("dst_of"), F.lit("rev_dst_of")))
    return incident.select("run_id", "pos", F.explode(kinds).alias("edge_type"), "event_id", "entity_id")


def follow_ends(nodes: DataFrame) -> DataFrame:
    """(run_id, pos, event_id, order, edge_type, end): a row for each end of an event."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("edge_type"), F.col(end).alias("end")) for kind, end in (("follows_src", "src_id"), ("follows_dst", "dst_id"))])
    return nodes.select("run_id", "pos", "event_id", "order", F.inline(kinds))


def predecessors(most: int) -> WindowSpec:
    """The frame of the up to ``most`` events before one in its window with the same end, over ``follow_ends``."""
    return Window.partitionBy("run_id", "pos", "edge_type", "end").orderBy("order").rowsBetween(-most, -1)


def follow_edges(nodes: DataFrame, most: int) -> DataFrame:
    """(run_id, pos, edge_type, src, dst): each event after its up to ``most`` predecessors with the same source, and with the same destination.

    Both ends of an event become one row each, and the predecessors are a row frame over one ordering by endpoint, so nothing is joined.
    """
    linked = follow_ends(nodes).withColumn("before", F.collect_list("event_id").over(predecessors(most)))
    return linked.select("run_id", "pos", "edge_type", F.explode("before").alias("src"), F.col("event_id").alias("dst"))


def recurrence_edges(copies: DataFrame, memory: int) -> DataFrame:
    """(run_id, entity_id, pos, later): all pairs of an entity's copies less than ``memory`` windows apart, by an equality join."""
    ahead = copies.withColumn("later", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + memory - 1))) if memory > 1 else copies.withColumn("later", F.lit(None).cast("long")).limit(0)
    return ahead.join(copies.withColumnRenamed("pos", "later"), ["run_id", "entity_id", "later"]).select("run_id", "entity_id", "pos", "later")


def in_memory(by_position: DataFrame, windows: DataFrame, memory: int) -> DataFrame:
    """Rows by position once for each newest window that remembers them, with newest and age."""
    return by_position.join(memory_members(windows, memory), ["run_id", "pos"])


def typed_edges(nodes: DataFrame, incident: DataFrame, copies: DataFrame, flow_memory: int, memory: int) -> DataFrame:
    """(run_id, pos, later, relation, src, dst): all seven relations in one table. Ids are of events and entities, as the relation tells;
    the source lies in window pos and the destination in window later."""
    follows = follow_edges(nodes, flow_memory).select("run_id", "pos", F.col("pos").alias("later"), F.col("edge_type").alias("relation"), "src", "dst")
    return other_edges(incident, copies, memory).unionByName(follows)


def other_edges(incident: DataFrame, copies: DataFrame, memory: int) -> DataFrame:
    """``typed_edges`` without the chains of events."""
    c = F.col
    spatial = spatial_edges(incident)
    back = c("edge_type").startswith("rev_")
    spatial = spatial.select("run_id", "pos", c("pos").alias("later"), c("edge_type").alias("relation"), F.when(back, c("event_id")).otherwise(c("entity_id")).alias("src"), F.when(back, c("entity_id")).otherwise(c("event_id")).alias("dst"))
    recurs = recurrence_edges(copies, memory).select("run_id", "pos", "later", F.lit("recurs").alias("relation"), c("entity_id").alias("src"), c("entity_id").alias("dst"))
    return spatial.unionByName(recurs)
