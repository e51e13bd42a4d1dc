"""Column-level work: parsing raw rows into model input, and metrics."""

from .metrics import (
    area_under_roc,
    classification_by_class,
    classification_metrics,
    classification_with_roc,
    clustering_metrics,
    confusion,
    regression_metrics,
    score_counts,
    topic_metrics,
)
from .parse import FeatureColumns, apply_data_spec, divide, parse_records, rejected_records

__all__ = [
    "FeatureColumns",
    "apply_data_spec",
    "area_under_roc",
    "classification_by_class",
    "classification_metrics",
    "classification_with_roc",
    "clustering_metrics",
    "confusion",
    "divide",
    "parse_records",
    "regression_metrics",
    "rejected_records",
    "score_counts",
    "topic_metrics",
]
