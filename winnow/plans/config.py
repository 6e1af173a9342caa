"""Default settings of an experiment, and merging of overrides."""

from __future__ import annotations

import copy
from collections.abc import Mapping

# --- fixed values: default settings ---
DEFAULTS: dict = {
    "dataset": "student_grades",
    "splits": {"strategy": "random", "test_size": 0.2, "val_size": 0.2, "random_state": 42},
    "feature_engineering": {"target_encoding": {"strategy": "naive", "smoothing": 0.0, "min_category_size": 0}},
    "fs": {
        "holdout_fraction": 0.25,
        "n_fs_models": 3,
        "topk_shap": 40,
        "fs_eval": {"neg_pos_ratio": 8},
        "thresholds": {"delta_abs_min": 0.001, "k_noise_std": 2.0},
        "rest_policy": "keep_all",
        "drop_negative_features": True,
        "overfit_filter": {
            "enabled": False, "max_shap_rank": 25, "delta_max": 0.0005, "delta_std_max": 0.002, "action": "drop",
        },
        "gain_overfit_filter": {
            "enabled": False, "max_gain_rank": 25, "delta_max": 0.0005, "delta_std_max": 0.002, "action": "drop",
        },
    },
    "fs_modes": {
        "aggressive": {
            "thresholds": {"delta_abs_min": 0.004, "k_noise_std": 1.0},
            "rest_policy": "drop_all", "drop_negative_features": True,
        },
        "moderate": {
            "thresholds": {"delta_abs_min": 0.0025, "k_noise_std": 1.8},
            "rest_policy": "keep_all", "drop_negative_features": True,
        },
        "mild": {
            "thresholds": {"delta_abs_min": 0.0, "k_noise_std": 0.5},
            "rest_policy": "keep_all", "drop_negative_features": False,
        },
    },
    "fs_primary_mode": "moderate",
    "fs_search": {
        "mode": "profiles",
        "frontier": {
            "delta_abs_min_values": [], "k_noise_std_values": [], "rest_policies": [], "drop_negative_options": [],
            "max_candidates": 8,
        },
    },
    "xgb_fs_params": {
        "max_depth": 5, "min_child_weight": 10, "subsample": 0.8, "colsample_bytree": 0.8, "lambda": 1.0, "eta": 0.1,
        "n_estimators": 300,
    },
    "xgb_final_params": {
        "max_depth": 6, "min_child_weight": 10, "subsample": 0.8, "colsample_bytree": 0.8, "lambda": 2.0, "eta": 0.05,
        "n_estimators": 2000, "early_stopping_rounds": 100,
    },
    "selection": {"val_tolerance_relative": 0.01, "gap_penalty_weight": 0.3},
}
FS_PATIENCE, FINAL_PATIENCE = 50, 100  # where the parameters name none
# --- end of fixed values ---


def merged(base: Mapping, *overrides: Mapping | None) -> dict:
    """Nested dicts merge key by key; every other value replaces."""
    out = copy.deepcopy(dict(base))
    for changes in overrides:
        for key, value in (changes or {}).items():
            both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
            out[key] = merged(out[key], value) if both else copy.deepcopy(value)
    return out


def mode_rules(config: Mapping) -> dict[str, dict]:
    """The named profiles, each the base rules with its own changes."""
    base = config.get("fs") or {}
    named = config.get("fs_modes") or {"moderate": {}}
    return {name: merged(base, changes) for name, changes in named.items()}
