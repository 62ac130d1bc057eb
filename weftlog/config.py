"""Configuration: nested dictionaries, dotted overrides, and an overlay for each detector."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

#: Defaults of the window detector; the overlay of another detector restates what differs. Fixed values.
DEFAULTS: dict[str, Any] = {
    "seed": 17,
    "detector": "flash",
    "data": {"runs_glob": "runs/*", "benchmarks": ["boutique"], "parquet_dir": "data/parquet", "val_frac": 0.2, "test_frac": 0.2},
    "windows": {"width_s": 30, "stride_s": 15, "min_tail_s": 15, "memory": 5},
    "events": {"l4_keep": ["non_forwarded", "syn_no_ack", "udp_first"], "drop_control_plane_audit": True},
    "sentences": {"max_tokens": 256, "max_repeats_per_signature": 3, "strip_verdict_tokens": False},
    "w2v": {"dim": 64, "window": 5, "min_count": 2, "epochs": 15, "negatives": 0},
    "graph": {"include_workload_nodes": False, "reverse_edges": True, "flow_memory": 20, "max_events_per_window": 1000},
    "features": {"time_enc_dim": 16, "path_vocab": 64, "dns_vocab": 32, "api_resource_vocab": 32},
    "model": {"objective": "flash_cls", "hops": 2},
    "train": {"max_iter": 100, "reg": 1e-3, "xgb": {"n_estimators": 300, "max_depth": 6, "learning_rate": 0.1, "early_stopping_rounds": 20}},
    "scoring": {"source": "xgb", "threshold_q": 0.995, "threshold_on": "score_norm"},
    "artifacts_dir": "artifacts/default",
    "results_dir": "results_eval",
    "detectors": {
        "flash": {},
        "ppt": {
            "artifacts_dir": "artifacts/ppt", "results_dir": "results_eval/ppt", "windows": {"width_s": 5, "stride_s": 5, "min_tail_s": 2.5, "memory": 5}, "model": {"objective": "ppt_cls", "layers": 2, "width": 32, "hidden": 32},
            # step sizes are for one step a round over all rows
            "train": {
                "pretrain": {"enabled": True, "lr": 1e-2, "epochs": 40, "patience": 8, "neg_ratio": 1.0, "holdout_frac": 0.3, "max_pos_per_type": 2000},
                "finetune": {"lr": 1e-2, "weight_decay": 5e-4, "max_epochs": 100, "patience": 15}, "scratch_lr": 1e-3,
            },
        },
    },
}


def get(config: dict, path: str, default: Any = None) -> Any:
    """The value at a dotted path."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def put(config: dict, path: str, value: Any) -> None:
    *parents, last = path.split(".")
    for part in parents:
        config = config.setdefault(part, {})
    config[last] = value


def merge(base: dict, overlay: dict) -> dict:
    """Dictionaries merge key by key; lists and scalars of the overlay replace."""
    out = copy.deepcopy(base)
    for key, value in overlay.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def _parse(text: str) -> Any:
    """An override's value: YAML where it can be read, else JSON, else the text."""
    try:
        import yaml
    except ImportError:
        try:
            return json.loads(text)
        except ValueError:
            return text
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        return text


def load(path: str | Path | None = None, overrides: list[str] | None = None) -> dict:
    """Defaults, a YAML or JSON file over them, and key=value overrides over both."""
    config = copy.deepcopy(DEFAULTS)
    if path is not None:
        config = merge(config, _parse(Path(path).read_text()) or {})
    for item in overrides or []:
        key, sep, value = item.partition("=")
        if not sep:
            raise ValueError(f"an override is key=value, not {item!r}")
        put(config, key.strip(), _parse(value.strip()))
    return config


def view(config: dict) -> dict:
    """The configuration as its detector sees it."""
    return merge(config, get(config, f"detectors.{get(config, 'detector', 'flash')}") or {})
