"""Text and JSON files of run directories as tables."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlog.scratch import written
from weftlog.sources.ranges import encoded


def _read(spark: SparkSession, pattern: str, whole: bool) -> DataFrame | None:
    try:
        return spark.read.text(pattern, wholetext=whole)
    except AnalysisException as e:  # a source that no run has is empty
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def run_dir_of(path: F.Column, below: int):
    """The run directory of a file that lies ``below`` levels under it."""
    return F.regexp_replace(path, "(/[^/]+){%d}$" % below, "")


def documents(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(run_dir, text) of one small file for each run."""
    below = name.count("/") + 1
    found = _read(spark, f"{root}/{name}", True)
    if found is None:
        return spark.createDataFrame([], "run_dir string, text string")
    return found.select(run_dir_of(F.col("_metadata.file_path"), below).alias("run_dir"), F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, root: str, name: str, runs: DataFrame | None = None) -> DataFrame:
    """(run_dir, file, lineno, line), with 1-based physical line numbers; with ``runs`` (run_dir, ...) only their lines, with what these say of a run.

    Files are read in splits, so one large file is many tasks; a folder in place of a file stands for its parts, plain or compressed,
    in order of their names.  A line's number is its place in its split and the lines of the splits before.  The lines are written once with their splits and read from there, since another scan of the files
    may be split otherwise (executors lost or gained).  What follows from a path is found for each split and not for each line.
    """
    found = _read(spark, f"{root}/{name}", False)
    if found is None:
        none = spark.createDataFrame([], "run_dir string, file string, lineno long, line string")
        return none if runs is None else none.join(runs, "run_dir")
    rows = written(found.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")), "lines", "zstd")
    blocks = rows.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    own = "[^/]*".join(re.escape(encoded(piece)) for piece in name.split("*"))
    blocks = blocks.withColumns({end: F.regexp_extract("path", f"^(.*)/({own})(/[^/]+)?$", i) for i, end in ((1, "run_dir"), (2, "file"))})
    before = F.sum("n").over(Window.partitionBy("run_dir", "file").orderBy("path", "block")) - F.col("n")
    starts = blocks.select("path", "block", (before - F.col("first") + 1).alias("shift"), "run_dir", "file")
    if runs is not None:
        starts = starts.join(runs, "run_dir")
    starts = written(starts, "splits")
    out = rows.join(F.broadcast(starts), ["path", "block"])  # a row for each split of a file
    line = F.trim(F.rtrim("value", F.lit("\r")))
    return out.select("run_dir", "file", (F.col("id") + F.col("shift")).alias("lineno"), line.alias("line"), *[x for x in starts.columns if x not in ("path", "block", "shift", "run_dir", "file")])
