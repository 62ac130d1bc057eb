"""From scores to alerts and evaluation figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.operators.stats import midrank_normalised, quantile
from weftlog.schema import L4, OTHER, POD


def quantile_thresholds(scores: DataFrame, q: float = 0.995) -> DataFrame:
    """(node_type, threshold): quantiles of the raw scores of benign runs. Types without scores are left out."""
    return quantile(scores, "node_type", "score_raw", q)


def normalised(scores: DataFrame, benign: DataFrame) -> DataFrame:
    """Adds score_norm, the mid-rank of the raw score among benign ones of its node type."""
    return midrank_normalised(scores, benign.select("node_type", "score_raw"), "node_type", "score_raw")


def apply_thresholds(scores: DataFrame, thresholds: DataFrame, on: str = "score_norm") -> DataFrame:
    """Adds threshold (1.0 where the type has none) and is_alert.

    Thresholds are fitted on raw scores and, by default, compared with the normalised ones; ``on='score_raw'`` compares like with like.
    """
    out = scores.join(thresholds.select("node_type", "threshold"), "node_type", "left").withColumn("threshold", F.coalesce("threshold", F.lit(1.0)))
    return out.withColumn("is_alert", F.col(on) >= F.col("threshold"))


def top_mean(values, n: int = 3):
    """Mean of the ``n`` largest values of an array."""
    top = F.slice(F.sort_array(values, asc=False), 1, n)
    return F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)


def pod_alerts(scores: DataFrame, value: str = "score_norm") -> DataFrame:
    """One row for each pod of a run: windows, largest score, mean of the three largest, threshold and label of the first window, any alert.

    Without pods it is empty.  The list that is sorted holds a pod's windows of one run.
    """
    pods = scores.where(F.col("node_type") == POD)
    return pods.groupBy("run_id", "entity_id").agg(
        F.count(F.lit(1)).alias("windows"), F.max(value).alias("max_score"), top_mean(F.collect_list(value)).alias("top3_mean"), F.min_by("threshold", "w_idx").alias("threshold"),
        F.bool_or("is_alert").alias("is_alert"), F.min_by("true_label", "w_idx").alias("true_label"),
    )


def ordered_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("max_score"), "run_id", "entity_id")


def benign_fp(scores: DataFrame) -> DataFrame:
    """One row: pod windows, share of labelled ones with a wrong label, share of alerts."""
    wrong = F.when(F.col("true_label") != OTHER, (F.col("true_label") != F.col("pred_label")).cast("double"))
    return scores.where(F.col("node_type") == POD).agg(F.count(F.lit(1)).alias("node_windows"), F.avg(wrong).alias("misclassification_rate"), F.avg(F.col("is_alert").cast("double")).alias("alert_rate"))


def dropped_endpoints(placed: DataFrame) -> DataFrame:
    """(run_id, w_idx, entity_id) with a flow in the window that was not forwarded; a missing verdict counts as such."""
    dropped = placed.where((F.col("event_type") == L4) & ~F.col("verdict").eqNullSafe("FORWARDED"))
    return dropped.select("run_id", "w_idx", F.explode(F.array("src_id", "dst_id")).alias("entity_id")).distinct()


def flagged(scores: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds is_flagged: whether the entity's window is among ``flags``."""
    marks = flags.select("run_id", "w_idx", "entity_id", F.lit(True).alias("is_flagged"))
    return scores.join(marks, ["run_id", "w_idx", "entity_id"], "left").withColumn("is_flagged", F.coalesce("is_flagged", F.lit(False)))


def detection_rate(victims: DataFrame, threshold: float) -> DataFrame:
    """One row from (run_id, score_norm) of victims (null where a run's victim has no score): detected share of the runs, and runs."""
    by_run = victims.groupBy("run_id").agg(F.max("score_norm").alias("top"))
    return by_run.agg(F.avg(F.coalesce(F.col("top") >= threshold, F.lit(False)).cast("double")).alias("detection_rate"), F.count(F.lit(1)).alias("runs"))
