"""Configuration files and the coercion of command-line values."""

from __future__ import annotations

import json
import re
from pathlib import Path

TRUE, NONE = ("true", "1", "yes", "on"), ("none", "null", "")


def load(path: str) -> dict:
    """A YAML or JSON mapping from a local file of the driver."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    # YAML reads the bare words yes and no as flags, also as names.
    return {{True: "yes", False: "no"}.get(k, k) if isinstance(k, bool) else k: v for k, v in (yaml.safe_load(text) or {}).items()}


def merged(defaults: dict, from_file: dict, from_cli: dict) -> dict:
    """Command line over file over defaults; a value that is not given is None, and an explicit 0 counts."""
    return defaults | {k: v for k, v in from_file.items() if v is not None} | {k: v for k, v in from_cli.items() if v is not None}


def exclusions(value: dict) -> tuple[list[str], list[str]]:
    """(template ids, patterns) of an exclusion mapping."""
    return [str(t) for t in value.get("templates", [])], [re.compile(p).pattern for p in (*value.get("patterns", []), *value.get("regex", []))]


def flag(text: str) -> bool:
    return text.strip().lower() in TRUE


def variable(text: str):
    """None, an integer, a number or the text itself."""
    if text.strip().lower() in NONE:
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def pairs(items: list[str]) -> dict[str, str]:
    """key=value items."""
    bad = [i for i in items if "=" not in i]
    if bad:
        raise ValueError(f"not key=value: {', '.join(bad)}")
    return dict(i.split("=", 1) for i in items)


def selection(text: str, n: int) -> list[int]:
    """0-based choices of `1,3,5` or `all`."""
    found = list(range(n)) if text.strip().lower() == "all" else [int(x) - 1 for x in text.split(",") if x.strip()]
    if any(not 0 <= i < n for i in found):
        raise ValueError(f"choices lie between 1 and {n}")
    return found


#: The commands' settings with their defaults; a file has any of them, and the command line comes before it.
CREATE = {
    "data_dir": "./data", "event_patterns": ["*NAS*", "*PlatformClient*", "*PlatformManager*"], "latency_pattern": ["*latency*"], "system_pattern": ["*Information*"], "extensions": None,
    "file_limit": 50, "bucket_duration": 5, "spike_threshold": 100.0, "output_root": "out", "force": False, "verify": True, "save_summary": False, "skip_validation": False, "strict_mode": False, "yes": False, "quiet": False,
}
_WINDOWS = {
    "incident": None, "incident_substring": None, "equivalents": [], "bucket_path": None, "output_root": "artifacts", "artifacts": None, "lead_minutes": 5, "max_minutes": 60, "lookback_minutes": 30,
    "symptom_substring": None, "symptom_variables": {}, "bucket_filters": {}, "exclude_file": None, "exclude_ids": [], "exclude_patterns": [], "exclude_metrics": [],
    "threshold_policy": "negative-quantile", "threshold_rate": 0.001, "fixed_threshold": 0.5, "window_analysis": True, "episode_collapse": True, "episode_gap_min_intervals": 5,
    "itemset_threshold": 1.0, "support": 0.2, "confidence": 0.5, "negative_mode": "time-matched", "negative_tolerance": 60, "negatives_per_positive": 1, "interactions": 0,
    "cv_strategy": "none", "cv_folds": 5, "cv_test_size": None, "auto_lookback": False, "auto_lookback_metric": "recall", "balance": True, "rounds": 100, "shap_top_k": 5, "shap_bucket_limit": 10, "shap_report_top_n": 10, "details": "compact",
}
SHAP = _WINDOWS
WINDOW_ANALYSIS = _WINDOWS | {"shap_top_k": 5}
EVALUATE = _WINDOWS | {"lead_minutes": 15, "window_analysis": False, "episode_collapse": False, "episode_gap_min_intervals": 20}


def settings(defaults: dict, path: str | None, given: dict) -> dict:
    """The defaults, what a file changes, and what the command line changes; a name that no default has is an error."""
    own = load(path) if path else {}
    if unknown := sorted(set(own) - set(defaults)):
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return merged(defaults, own, {k: v for k, v in given.items() if k in defaults})


def default_text(defaults: dict) -> str:
    """A configuration file with all defaults, to be edited. It reads as YAML and, line by line, as JSON values."""
    return "".join(f"{json.dumps(name)}: {json.dumps(value)}\n" for name, value in defaults.items())


def write_default(path: str, defaults: dict) -> None:
    """Write default_text to a new local file of the driver; an existing one is left alone."""
    with open(path, "x", encoding="utf-8") as file:
        file.write(default_text(defaults))
