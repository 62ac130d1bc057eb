"""Supervision for link prediction: held-out links, capped positives and sampled non-links, relation by relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.scratch import written

#: Values of an end's number that are ranked in one task.
BLOCK = 1000
#: A relation in a graph; ``later`` is the window of the destination, ``pos`` for all relations within a window.
GRAPH = ["run_id", "pos", "later", "relation"]
#: Mirrored relations and their forward twins.
MIRRORS = {"rev_src_of": "src_of", "rev_dst_of": "dst_of"}
#: Values that a draw can take.
DRAWS = 1 << 32


def held_out(a: Column, b: Column, tenths: int = 3) -> Column:
    """Whether a link of the numbers a and b is held out; a link and its reverse share the answer."""
    return (F.least(a, b) * 31 + F.greatest(a, b) * 17) % 10 < tenths


def negatives(edges: DataFrame) -> DataFrame:
    """(src, dst): for each edge (src, dst, a, b) another destination by a hash, where that is no edge and no loop.

    Destinations are numbered and joined by number, so candidates grow with the edges and not with the pairs of nodes.
    """
    ends = edges.select("dst", "b").distinct()
    # numbers in order of (b, dst): within blocks of BLOCK values of b, then the blocks, one row each, in one task
    blocked = ends.withColumn("block", F.coalesce(F.floor(F.col("b") / BLOCK), F.lit(-(1 << 62))))
    sizes = blocked.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("block", (F.sum("size").over(Window.orderBy("block")) - F.col("size")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("block").orderBy("b", "dst")) - 1
    numbered = blocked.withColumn("nth", nth).join(before, "block").select("dst", (F.col("before") + F.col("nth")).cast("long").alias("i"))
    total = ends.agg(F.count(F.lit(1)).alias("n"))
    tries = edges.join(F.broadcast(total)).select("src", ((F.col("a") * 13 + F.col("b") * 7 + 1) % F.col("n")).alias("i"))
    drawn = tries.join(numbered, "i").select("src", "dst").where("src <> dst").distinct()
    return drawn.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def draw(seed: int, *columns: Column) -> Column:
    """A number from 0 to 2**32 - 1 that depends on the seed and the columns' texts alone: the first hex digits of their MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def link_draw(seed: int) -> Column:
    """The draw of a typed edge; a mirrored edge has that of its forward twin, so both share all that follows from it."""
    c = F.col
    forward = F.create_map(*[F.lit(x) for pair in MIRRORS.items() for x in pair])
    twin = F.try_element_at(forward, c("relation"))
    flip = lambda a, b: F.when(twin.isNotNull(), c(b)).otherwise(c(a))
    return draw(seed, c("run_id"), c("pos"), c("later"), F.coalesce(twin, c("relation")), flip("src", "dst"), flip("dst", "src"))


def supervised(edges: DataFrame, share: float = 0.3, seed: int = 17) -> DataFrame:
    """Adds held: whether a typed edge (run_id, pos, later, relation, src, dst) is kept from the messages, to be predicted."""
    return edges.withColumn("held", link_draw(seed) < F.lit(int(share * DRAWS)))


def smallest(rows: DataFrame, key: str, number: Column, most: int, *ties: str) -> DataFrame:
    """At most ``most`` rows of each key, those of smallest number (0 to 2**32 - 1), then by ``ties``.

    Rows are counted by key and the number's upper half first, in partial sums: that is a bounded table, from which follows in which
    bin the last row lies.  Only rows up to this bin are kept, and only its own are ordered, so no key is sorted and no task sees a whole one.
    """
    marked = rows.withColumn("_number", number).withColumn("_bin", F.shiftright("_number", 16))
    bins = marked.groupBy(key, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_bin")) - F.col("_n")
    room = bins.select(key, "_bin", (F.lit(most) - before).alias("_room")).where("_room > 0")
    place = F.row_number().over(Window.partitionBy(key, "_bin").orderBy("_number", *ties))
    return marked.join(room, [key, "_bin"]).withColumn("_place", place).where("_place <= _room").drop("_number", "_bin", "_room", "_place")


def numbered_ends(edges: DataFrame, end: str) -> DataFrame:
    """(run_id, pos, later, relation, end, i, n): the distinct ends of a relation in a graph, numbered from 0, and how many there are. Graphs are bounded by the cap on events."""
    over = Window.partitionBy(*GRAPH)
    ends = edges.select(*GRAPH, end).distinct()
    return ends.select(*GRAPH, end, (F.row_number().over(over.orderBy(end)) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(over).alias("n"))


def relation_negatives(positives: DataFrame, edges: DataFrame, ratio: int = 1, seed: int = 17, tries: int = 8) -> DataFrame:
    """(run_id, pos, later, relation, src, dst): for each positive ``ratio`` pairs of its own relation's ends in its own graph that are no edge and no loop.

    Both ends are drawn by number from the ends that the relation has in the graph, and joined by number, so candidates grow with the
    positives and not with pairs of nodes.  All ``tries`` draws of a positive are made at once, and the first that hits no edge counts,
    so edges and ends are read once and not for each try; the draws are written after each join, as their true size tells the planner
    that edges need no shuffle to meet them.  A graph without non-edges gives none, and a pair drawn twice is one.
    """
    c, link = F.col, [*GRAPH, "src", "dst"]
    sources, sinks = written(numbered_ends(edges, "src"), "sources"), written(numbered_ends(edges, "dst"), "sinks")
    sizes = sources.where("i = 0").select(*GRAPH, c("n").alias("n_src")).join(sinks.where("i = 0").select(*GRAPH, c("n").alias("n_dst")), GRAPH)
    count = lambda first, last: F.explode(F.sequence(F.lit(first), F.lit(last)))
    open_ = positives.select(*GRAPH, c("src").alias("of_src"), c("dst").alias("of_dst"), count(1, ratio).alias("copy")).join(sizes, GRAPH).withColumn("attempt", count(0, tries - 1))
    at = lambda side, n: draw(seed, F.lit(side), *map(c, (*GRAPH, "of_src", "of_dst", "copy", "attempt"))) % c(n)
    drawn = written(open_.withColumns({"i_src": at("src", "n_src"), "i_dst": at("dst", "n_dst")}).drop("n_src", "n_dst"), "draws")
    drawn = written(drawn.join(sources.select(*GRAPH, c("i").alias("i_src"), "src"), [*GRAPH, "i_src"]), "drawn-sources")
    drawn = written(drawn.join(sinks.select(*GRAPH, c("i").alias("i_dst"), "dst"), [*GRAPH, "i_dst"]).where("src <> dst").drop("i_src", "i_dst"), "drawn")
    hits = written(edges.select(*link).join(drawn.select(*link), link, "left_semi").distinct(), "hits")
    good = drawn.join(hits, link, "left_anti")
    first = good.groupBy(*GRAPH, "of_src", "of_dst", "copy").agg(F.min_by(F.struct("src", "dst"), "attempt").alias("pair"))
    return first.select(*GRAPH, "pair.src", "pair.dst").distinct()
