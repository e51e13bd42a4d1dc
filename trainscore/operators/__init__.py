"""The steps a job is made of: split, fit, score, save."""

from .sinks import current_model, save_indicator, save_model, save_predictions
from .split import Split, drop_sides, keyed_split, random_split, row_split, side_of_key, with_row_key

__all__ = [
    "Split",
    "current_model",
    "drop_sides",
    "keyed_split",
    "random_split",
    "row_split",
    "save_indicator",
    "save_model",
    "save_predictions",
    "side_of_key",
    "with_row_key",
]
