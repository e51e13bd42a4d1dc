"""Run a job from a settings file: ``python -m trainscore train settings.json``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from trainscore import BatchSpec, StreamSpec, TrainSpec, run_batch, run_stream, run_train

JOBS = {"train": (TrainSpec, run_train), "batch": (BatchSpec, run_batch), "stream": (StreamSpec, run_stream)}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="trainscore", description=__doc__.splitlines()[0])
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("settings", help="JSON file, or JSON text starting with '{'")
    args = parser.parse_args(argv)

    text = args.settings if args.settings.lstrip().startswith("{") else Path(args.settings).read_text()
    spec_class, run = JOBS[args.job]
    spec = spec_class.parse(json.loads(text))
    spark = SparkSession.builder.appName(spec.app_name).getOrCreate()
    try:
        run(spark, spec)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
