"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.storage import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node of its component. ``links`` is read several times.

    Large-star and small-star steps in turn: the first moves a node's larger neighbours, the second its smaller ones, to the
    smallest of them.  They keep the number of links, end in stars, and take about log(nodes) rounds; links that are stars already, as
    those of an earlier call, take fewer.  Each step is a minimum by key, which is pre-aggregated, and a join; nothing is gathered by
    key, though a join deals a hub's links, two numbers each, to one task.  A round is one job, and one aggregation tells whether another is needed.
    """
    now = links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x != y")
    stars = False
    while not stars:  # ends, as each round moves links to smaller nodes, and nothing but stars stays as it is
        least = now.select(F.inline(F.array(F.struct(F.col("x").alias("n"), F.col("y").alias("m")), F.struct(F.col("y").alias("n"), F.col("x").alias("m")))))
        least = least.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("m"))
        large = now.join(least, F.col("y") == F.col("n")).select("x", F.col("m").alias("y"))
        # a node itself also moves to the smallest of its smaller neighbours
        small = large.join(large.groupBy("x").agg(F.min("y").alias("m")), "x").select(F.inline(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))))
        now = written(small.where("x != y").distinct(), "links")
        stars = _stars(now)
    roots = now.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots.union(roots.select("root", "root")).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether each larger end x has one link, and none is the smaller end y of another."""
    ends = links.select(F.inline(F.array(F.struct(F.col("x").alias("n"), F.lit(1).alias("up")), F.struct(F.col("y").alias("n"), F.lit(0).alias("up")))))
    told = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return told.agg(F.count_if((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("low") == 0)))).first()[0] == 0
