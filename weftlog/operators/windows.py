"""Sliding event-time windows anchored at each run's first event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.scratch import written


@dataclass(frozen=True)
class WindowSpec:
    """Width, stride and least tail in microseconds."""

    width: int
    stride: int
    least_tail: int

    @classmethod
    def seconds(cls, width: float, stride: float, least_tail: float) -> WindowSpec:
        return cls(*(round(x * 1_000_000) for x in (width, stride, least_tail)))


def _quotient(value: Column, by: int) -> Column:
    """Floor of an exact division of longs."""
    return ((value - F.pmod(value, F.lit(by))) / by).cast("long")


def run_spans(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg(F.min("ts_us").alias("run_start"), F.max("ts_us").alias("run_end"))


def last_position(spec: WindowSpec, start: Column, end: Column) -> Column:
    """The last window's position: all full ones, and the partial one behind them if it is the only one or long enough."""
    span = end - start
    full = F.when(span >= spec.width, _quotient(span - spec.width, spec.stride) + 1).otherwise(F.lit(0).cast("long"))
    rest = span - full * spec.stride
    return F.when((full == 0) | ((rest >= spec.least_tail) & (rest >= 0)), full).otherwise(full - 1)


def positioned(events: DataFrame, spec: WindowSpec) -> DataFrame:
    """Each event once for every window that holds it: adds pos (the window's place in its run, empty ones counted) and t0_us.

    An event's windows follow from its time alone, so this is an explosion of width / stride rows and no range join. The runs'
    spans are one row each.
    """
    joined = events.join(F.broadcast(run_spans(events)), "run_id")  # a row of three numbers for each run
    since = F.col("ts_us") - F.col("run_start")
    first = F.greatest(F.lit(0).cast("long"), _quotient(since - spec.width, spec.stride) + 1)
    last = F.least(_quotient(since, spec.stride), last_position(spec, F.col("run_start"), F.col("run_end")))
    out = joined.withColumns({"_first": first, "_last": last}).where(F.col("_first") <= F.col("_last"))
    out = out.withColumn("pos", F.explode(F.sequence("_first", "_last"))).withColumn("t0_us", F.col("run_start") + F.col("pos") * spec.stride)
    return out.drop("_first", "_last", "run_start", "run_end")


def window_table(placed: DataFrame) -> DataFrame:
    """The windows that hold an event: run_id, pos, t0_us, and w_idx, which counts only these.

    One row for each window, so that the numbering of a run shuffles windows and not events.
    """
    windows = placed.select("run_id", "pos", "t0_us").distinct()
    return windows.withColumn("w_idx", F.row_number().over(Window.partitionBy("run_id").orderBy("pos")).cast("long") - 1)


def assign_windows(events: DataFrame, spec: WindowSpec) -> DataFrame:
    """``positioned`` with w_idx."""
    placed = positioned(events, spec)
    # written, so that its true size tells the planner whether events must be shuffled to meet it
    return placed.join(written(window_table(placed).drop("t0_us"), "windows"), ["run_id", "pos"])


def memory_members(windows: DataFrame, memory: int) -> DataFrame:
    """(run_id, newest, pos, age): the windows in the memory of each window, itself included; gaps contribute nothing."""
    newest = windows.select("run_id", F.col("pos").alias("newest"))
    reach = windows.select("run_id", "pos", F.explode(F.sequence(F.lit(0), F.lit(memory - 1))).alias("age"))
    return reach.withColumn("newest", F.col("pos") + F.col("age")).join(newest, ["run_id", "newest"]).select("run_id", "newest", "pos", "age")
