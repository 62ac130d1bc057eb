import json

import pytest
from pyspark.sql import functions as F

from weftlog import cli, config
from weftlog.plans import detectors, workflow
from weftlog.schema import SCORES
from weftlog.sources import runs

RUNS = ["boutique-mix_20250304-090000", "boutique-mix_20250304-100000", "boutique-mix_20250304-110000"]
SMALL = ["windows.width_s=60", "windows.stride_s=60", "windows.min_tail_s=10", "w2v.dim=8", "w2v.epochs=1", "w2v.min_count=1", "train.xgb.n_estimators=2", "train.xgb.max_depth=2", "train.max_iter=5", "detectors.ppt.windows.width_s=60", "detectors.ppt.windows.stride_s=60", "detectors.ppt.model.width=8", "detectors.ppt.model.hidden=6", "detectors.ppt.train.pretrain.epochs=2", "detectors.ppt.train.finetune.max_epochs=3"]


@pytest.fixture(params=["flash", "ppt"])
def trained(request, spark, ingested, tmp_path):
    own = config.load(None, [f"detector={request.param}", f"data.parquet_dir={ingested}", *SMALL, *(f"detectors.{request.param}.{k}={tmp_path}/{k[:4]}" for k in ("artifacts_dir", "results_dir"))])
    return own, workflow.train(spark, own)


def test_train_score_eval(spark, trained):
    own, detector = trained
    assert detector.splits == {"train": RUNS[:1], "val": RUNS[1:2], "test": RUNS[2:]}
    scores, found = workflow.score(spark, own)
    assert {f.name for f in SCORES} <= set(scores.columns) and {r.run_id for r in scores.select("run_id").distinct().collect()} == set(RUNS[2:])
    assert scores.where("score_raw < 0 OR score_raw > 1 OR score_norm < 0 OR score_norm > 1 OR score_norm IS NULL").count() == 0
    assert scores.where("true_label = '<other>' AND score_raw <> 1").count() == 0
    assert found.count() == scores.where("node_type = 'Pod'").select("entity_id").distinct().count() > 0

    again = detectors.load_detector(spark, config.view(own))
    events, entities = runs.load(spark, config.get(own, "data.parquet_dir"), RUNS[2:])
    key = ["run_id", "w_idx", "entity_id"]
    both = again.score(events, entities).join(scores.select(*key, F.col("score_raw").alias("was")), key)
    assert both.count() == scores.count() and both.where(F.abs(F.col("score_raw") - F.col("was")) > 1e-9).count() == 0

    victim = spark.createDataFrame([(RUNS[2], "pod:default/web-5b8f7c9d44-kx2lp")], "run_id string, entity_id string")
    own_rows = lambda df: sorted((r.w_idx, round(r.score_raw, 9)) for r in df.where("entity_id = 'pod:default/web-5b8f7c9d44-kx2lp'").collect())
    assert own_rows(detector.score(events, entities, only=victim)) == own_rows(scores)

    report = workflow.evaluate(spark, own)
    assert set(report) == {"test_runs", "benign_fp", "weak_signal", "perturbations", "ablation"}
    assert set(report["perturbations"]) == {"rewire", "dns_exfil", "sentence_swap", "api_burst"}
    assert set(report["ablation"]) == set(detector.ablations())
    assert json.loads(open(f"{config.get(config.view(own), 'results_dir')}/eval_report.json").read())["test_runs"] == RUNS[2:]

    wrong = config.view(own) | {"detector": "ppt" if detector.name == "flash" else "flash"}
    with pytest.raises(SystemExit, match="is configured"):
        detectors.load_detector(spark, wrong)


def test_registry():
    assert detectors.get_detector("flash").name == "flash"
    with pytest.raises(KeyError, match="have"):
        detectors.get_detector("none")
    with pytest.raises(NotImplementedError):
        detectors.objective("masked_recon")


def test_command_line(spark, run_root, tmp_path, capsys):
    out = str(tmp_path / "tables")
    assert cli.main(["ingest", "--set", f"data.runs_glob={run_root}/*", "--set", f"data.parquet_dir={out}"], spark) == 0
    assert "3 runs" in capsys.readouterr().out
    assert runs.list_runs(spark, out) == RUNS
