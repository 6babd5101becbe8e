"""Prevalence estimation over groups of events, as Spark jobs.

The public names are loaded when they are first used.
"""

from importlib import import_module

__version__ = "0.2.0"

_HOMES = {
    "bagmeter.config": ("CLINICAL_RANGES", "LABELS"),
    "bagmeter.operators.bags": ("app_truth", "capp_truth", "members"),
    "bagmeter.operators.calibration": ("apply_platt", "cross_fitted", "fit_platt", "fit_temperature", "isotonic"),
    "bagmeter.operators.estimators": ("acc", "cc", "hdy", "matched", "median_sweep", "normalized", "pacc", "pcc", "threshold"),
    "bagmeter.operators.iterative": ("cde", "emq", "energy_distance", "hdx", "mixture", "readme"),
    "bagmeter.operators.labels": ("balance_report", "burden", "class_distribution"),
    "bagmeter.operators.metrics": ("absolute_error", "brier", "calibration_error", "check_scores", "zone_crossing_error", "zone_report"),
    "bagmeter.operators.scoring": ("centroid_scores", "centroids", "one_vs_rest_scores", "trained_scores"),
    "bagmeter.operators.split": ("guaranteed_split", "hash_split", "make_splits", "stratified_folds", "stratified_split"),
    "bagmeter.operators.timeline": ("most_diverse_window", "segment_bounds"),
    "bagmeter.pipeline": ("compare_protocols", "prepare_splits", "registry", "run_experiment", "run_grid"),
    "bagmeter.sources.bundle": ("ExportedBundle", "export_bundle"),
    "bagmeter.sources.checkpoint": ("ExperimentCheckpoint",),
    "bagmeter.sources.manifest": ("Source",),
    "bagmeter.sources.store": ("ArtifactStore",),
}
_HOME = {name: module for module, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(_HOME[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
