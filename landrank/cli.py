"""Command line: check-data, ingest, prepare, score, visualize, analyze."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from .plans import mapview, pipeline, report
from .sources import config as configuration
from .sources import ingest

COMMANDS = {
    "check-data": ("Check that required data files are present and readable.", ingest.check),
    "ingest": ("Ingest raw data into stored layers.", ingest.run),
    "prepare": ("Ingest, derive terrain and masks, build the candidate grid.", pipeline.prepare),
    "score": ("Score candidate cells and write ranked results.", pipeline.score),
    "visualize": ("Write an interactive map of the results.", mapview.run),
    "analyze": ("Print score distribution statistics.", report.run),
}


def logger(level: str | None = None) -> logging.Logger:
    """The engine's logger: level by argument, else LOG_LEVEL, else INFO; one handler however often it is called."""
    out = logging.getLogger("landrank")
    out.setLevel((level or os.environ.get("LOG_LEVEL") or "INFO").upper())
    if not out.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)-8s %(message)s"))
        out.addHandler(handler)
    return out


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="landrank", description="Rank land by suitability.")
    out.add_argument("--config", default="config.yaml", help="Path to config file")
    out.add_argument("--log-level", default=None, help="Logging level (DEBUG, INFO, WARNING, ERROR)")
    commands = out.add_subparsers(dest="command", required=True)
    for name, (text, _) in COMMANDS.items():
        commands.add_parser(name, help=text, description=text)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = parser().parse_args(arguments)
    log = logger(options.log_level)
    try:
        config = configuration.load(options.config)
        COMMANDS[options.command][1](spark or SparkSession.builder.appName("landrank").getOrCreate(), config)
    except (FileNotFoundError, ValueError) as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
