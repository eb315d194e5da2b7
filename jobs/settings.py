"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession


def command_line(description: str, paths: dict[str, str], argv: list[str] | None) -> argparse.Namespace:
    """The parsed arguments: --config and the job's paths, all needed."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", required=True, help="JSON file of the job's settings")
    for name, help_text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=help_text)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return parser.parse_args(argv)


def configuration(spark: SparkSession, path: str, known: set[str]) -> dict:
    """The settings of a JSON file, read by Spark like any other path; unknown ones raise ValueError."""
    row = spark.read.json(path, multiLine=True).first()
    found = {} if row is None else row.asDict(recursive=True)
    if not set(found) <= known:
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(set(found) - known))}")
    return found
