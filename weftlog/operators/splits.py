"""Runs in order of time, and their split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_order(runs: DataFrame) -> DataFrame:
    """Adds place: runs by the text behind the last underscore, then by id. One row for each run."""
    return runs.withColumn("place", F.row_number().over(Window.orderBy(F.substring_index("run_id", "_", -1), "run_id")) - 1)


def temporal_split(runs: DataFrame, val_frac: float, test_frac: float) -> DataFrame:
    """(run_id, place, split): the latest runs are test, those before them val, the rest train.

    With three runs or more val and test get at least one each, rounded half to even; with two, one is val.
    """
    total = runs.agg(F.count(F.lit(1)).alias("n"))  # one row
    part = lambda f: F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(f)).cast("int"))
    sized = total.select("n", F.when(F.col("n") >= 3, part(test_frac)).otherwise(0).alias("tests"), F.when(F.col("n") >= 3, part(val_frac)).when(F.col("n") == 2, 1).otherwise(0).alias("vals"))
    out = run_order(runs).join(F.broadcast(sized))
    name = F.when(F.col("place") >= F.col("n") - F.col("tests"), "test").when(F.col("place") >= F.col("n") - F.col("tests") - F.col("vals"), "val").otherwise("train")
    return out.select("run_id", "place", name.alias("split"))


def in_split(events: DataFrame, split: DataFrame, name: str) -> DataFrame:
    return events.join(split.where(F.col("split") == name).select("run_id"), "run_id", "left_semi")
