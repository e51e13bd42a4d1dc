"""Whole jobs over tables."""

from .jobs import TrainResult, run_batch, run_train

__all__ = ["TrainResult", "run_batch", "run_train"]
