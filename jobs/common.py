"""What the jobs share: config files, logging, the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import SparkSession


def config_of(job_file: str, path: str | None = None) -> dict:
    """The settings of a job: the JSON file beside it, or the one at ``path``, whose keys replace those."""
    settings = json.loads(Path(job_file).with_suffix(".json").read_text())
    more = json.loads(Path(path).read_text()) if path else {}
    unknown = set(more) - set(settings)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return settings | more


def command_line(what: str, *paths: str) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=what)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="JSON file with settings that differ from the job's own")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return parser.parse_args()


def session(name: str) -> SparkSession:
    """The session of a command line; master and resources come from spark-submit."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
