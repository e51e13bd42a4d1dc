"""Train, verify and apply machine-learning models on Spark tables and streams."""

from .plans import TrainResult, run_batch, run_train
from .plugins import Algorithm, Parameter, Scorer, register_algorithm, register_scorer
from .sources import load_source
from .spec import BatchSpec, DataSpec, SourceSpec, StreamSpec, TrainSpec
from .streaming import run_stream, start_stream

__all__ = [
    "Algorithm",
    "BatchSpec",
    "DataSpec",
    "Parameter",
    "Scorer",
    "SourceSpec",
    "StreamSpec",
    "TrainResult",
    "TrainSpec",
    "load_source",
    "register_algorithm",
    "register_scorer",
    "run_batch",
    "run_stream",
    "run_train",
    "start_stream",
]
