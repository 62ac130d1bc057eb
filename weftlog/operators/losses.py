"""Losses as aggregates: means within a relation or class first, then over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logit_loss(logit: Column, positive: Column) -> Column:
    """Binary cross-entropy of a logit, without overflow for large ones."""
    return F.greatest(logit, F.lit(0.0)) - F.when(positive, logit).otherwise(0.0) + F.log1p(F.exp(-F.abs(logit)))


def relation_losses(pairs: DataFrame, logit: str, positive: str, relation: str = "relation") -> DataFrame:
    """(relation, n, n_pos, loss): mean loss of a relation's links and non-links."""
    loss = logit_loss(F.col(logit), F.col(positive))
    return pairs.groupBy(relation).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("n_pos"), F.avg(loss).alias("loss"))


def macro_link_loss(pairs: DataFrame, logit: str, positive: str, relation: str = "relation") -> DataFrame:
    """One row (loss, relations): relations weigh alike, so dense ones do not drown sparse ones; one without a link is left out, and no relation gives null."""
    by = relation_losses(pairs, logit, positive, relation).where("n_pos > 0")
    return by.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("relations"))


def class_loss(rows: DataFrame, probs: str, y: str, weight: str, least: float = 1e-12) -> DataFrame:
    """One row (loss, n): weighted mean of minus the log of the own class's probability over rows that have a class (y above 0); 0 without any."""
    own = F.greatest(F.coalesce(F.get(F.col(probs), F.col(y)), F.lit(0.0)), F.lit(least))
    labelled = rows.where(F.col(y) > 0)
    total = labelled.agg(F.sum(F.col(weight) * -F.log(own)).alias("s"), F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))
    return total.select(F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0).alias("loss"), "n")


def macro_class_loss(rows: DataFrame, probs: str, y: str, least: float = 1e-12) -> DataFrame:
    """One row (loss, classes): the mean over classes of each class's mean loss, which is the weighted loss under balanced weights."""
    own = F.greatest(F.coalesce(F.get(F.col(probs), F.col(y)), F.lit(0.0)), F.lit(least))
    by = rows.where(F.col(y) > 0).groupBy(y).agg(F.avg(-F.log(own)).alias("loss"))
    return by.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("classes"))
