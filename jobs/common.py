"""What the jobs share: their command line and their log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

Run = Callable[..., dict]


def main(name: str, run: Run, arguments: dict[str, str]) -> None:
    """Runs a job from the command line, in a session that begins and ends with it; arguments are its paths with their help."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for argument, text in arguments.items():
        parser.add_argument(f"--{argument}", required=True, help=text)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")), help="JSON file with the job's settings (default: %(default)s)")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = settings(name, given.pop("config"))
    spark = SparkSession.builder.appName(f"jobs.{name}").getOrCreate()
    try:
        print(json.dumps(run(spark, **given, config=config)))
    finally:
        spark.stop()


def settings(name: str, path: str | None = None) -> dict:
    """The settings in a file on the driver; by default the one beside the job."""
    return json.loads((Path(path) if path else Path(__file__).with_name(f"{name}.json")).read_text())
