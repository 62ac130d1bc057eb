"""Train, score and evaluate a configured detector."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.config import get, merge, put, view
from weftlog.operators import alerts, splits, stats, windows
from weftlog.operators.perturb import PERTURBATIONS
from weftlog.plans.detectors import Detector, get_detector, load_detector, run_tables, window_spec
from weftlog.schema import POD
from weftlog.scratch import write_text, written
from weftlog.sources import runs


def ingest(spark: SparkSession, config: dict) -> list[str]:
    """Ingest all run directories and return their ids in order of time."""
    events, entities = runs.ingest(spark, get(config, "data.runs_glob"), get(config, "data.benchmarks"), tuple(get(config, "events.l4_keep")), bool(get(config, "events.drop_control_plane_audit")))
    runs.write_tables(events, entities, get(config, "data.parquet_dir"))
    return runs.list_runs(spark, get(config, "data.parquet_dir"))


def split_runs(spark: SparkSession, config: dict, ids: list[str]) -> dict[str, list[str]]:
    table = splits.temporal_split(spark.createDataFrame([(i,) for i in ids], "run_id string"), float(get(config, "data.val_frac")), float(get(config, "data.test_frac")))
    out: dict[str, list[str]] = {"train": [], "val": [], "test": []}
    for r in table.orderBy("place").collect():
        out[r.split].append(r.run_id)
    return out


def train(spark: SparkSession, config: dict) -> Detector:
    own = view(config)
    ids = runs.list_runs(spark, get(own, "data.parquet_dir"), get(own, "data.benchmarks"))
    if not ids:
        raise SystemExit("no ingested runs; ingest first")
    events, entities = run_tables(spark, own)
    out = get_detector(get(own, "detector")).train(own, events, entities, split_runs(spark, own, ids))
    out.save(get(own, "artifacts_dir"))
    return out


def _test_runs(spark: SparkSession, config: dict, detector: Detector) -> list[str]:
    return detector.splits.get("test") or runs.list_runs(spark, get(config, "data.parquet_dir"), get(config, "data.benchmarks"))


def _alerted(detector: Detector, config: dict, events: DataFrame, entities: DataFrame) -> DataFrame:
    return alerts.apply_thresholds(detector.score(events, entities, config), detector.tables["thresholds"], get(config, "scoring.threshold_on"))


def score(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """Scores and alerts of the test runs, written to the results folder."""
    own = view(config)
    detector = load_detector(spark, own)
    scores = _alerted(detector, own, *run_tables(spark, own, _test_runs(spark, own, detector)))
    out = get(own, "results_dir")
    scores.write.mode("overwrite").parquet(f"{out}/scores")
    scores = spark.read.parquet(f"{out}/scores")
    found = alerts.ordered_alerts(alerts.pod_alerts(scores))
    found.write.mode("overwrite").json(f"{out}/alerts")
    return scores, found


def weak_signal(detector: Detector, config: dict, events: DataFrame, entities: DataFrame) -> dict:
    """Whether pods with dropped flows score higher, with what the verdict tells and without."""
    dropped = alerts.dropped_endpoints(windows.assign_windows(events, window_spec(config)))
    out = {}
    for strip in (False, True):
        scores = detector.score(events, entities, config, strip_verdict=strip).where(F.col("node_type") == POD)
        row = stats.auc(alerts.flagged(scores, dropped), "score_norm", F.col("is_flagged")).first()
        out["strip_verdict" if strip else "with_verdict"] = row.asDict() if row else {"auc": None, "n_pos": 0, "n_neg": 0}
    return out


def perturbations(detector: Detector, config: dict, events: DataFrame, entities: DataFrame) -> dict:
    """Scores of victims before and after each mutation; all runs at once."""
    row = detector.tables["thresholds"].where(F.col("node_type") == POD).first()
    threshold, out = row.threshold if row else 1.0, {}
    for name, mutate in PERTURBATIONS.items():
        changed, victims = mutate(events, entities, int(get(config, "seed")))
        who = victims.select("run_id", F.col("victim").alias("entity_id"))
        changed, who = written(changed, "mutated"), written(who, "victims")
        own = lambda df, who=who: detector.score(df.join(who.select("run_id").distinct(), "run_id", "left_semi"), entities, config, only=who).join(who, ["run_id", "entity_id"], "left_semi").select("run_id", "score_norm")
        after = written(own(changed), "after")
        both = after.select("score_norm", F.lit(True).alias("p")).unionByName(own(events).select("score_norm", F.lit(False).alias("p")))
        area = stats.auc(both, "score_norm", F.col("p")).first()
        found = alerts.detection_rate(who.select("run_id").join(after, "run_id", "left"), threshold).first()
        out[name] = {"auc": area.auc if area else None, "detection_rate": found.detection_rate, "runs": found.runs}
    return out


def evaluate(spark: SparkSession, config: dict) -> dict:
    """The report on the test runs, also written to the results folder. It is one row for each figure, so the driver writes it."""
    own = view(config)
    detector = load_detector(spark, own)
    ids = _test_runs(spark, own, detector)
    events, entities = run_tables(spark, own, ids)
    report: dict = {"test_runs": ids, "benign_fp": alerts.benign_fp(_alerted(detector, own, events, entities)).first().asDict()}
    report["weak_signal"] = weak_signal(detector, own, events, entities)
    report["perturbations"] = perturbations(detector, own, events, entities)
    report["ablation"] = {}
    for name, changes in detector.ablations().items():
        fork = merge(own, {})
        for path, value in changes:
            put(fork, path, value)
        report["ablation"][name] = alerts.benign_fp(_alerted(detector, fork, events, entities)).first().asDict()
    write_text(spark, f"{get(own, 'results_dir')}/eval_report.json", json.dumps(report, indent=2))
    return report
