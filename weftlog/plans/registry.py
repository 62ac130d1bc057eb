"""The register of queries, and tables that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.operators import windows
from weftlog.plans.testdata import WINDOWS, telemetry
from weftlog.scratch import roomy

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    roomy(spark, f"{sf_dir}/{name}.parquet")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry events by window."""
    return windows.assign_windows(telemetry(spark, sf_dir), WINDOWS)


def rounded(*names: str) -> dict:
    """Doubles that two engines add up in different orders."""
    return {n: F.round(n, 6) for n in names}
