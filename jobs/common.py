"""What the jobs' command lines share: arguments, a configuration file, a log and a session."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from loreweave.errors import ConfigurationError

log = logging.getLogger("loreweave.jobs")


def settings(path: str | Path, known: dict[str, Any]) -> dict[str, Any]:
    """The mapping in a YAML file over the defaults ``known``; other keys are errors."""
    given = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(given, dict) or (unknown := set(given) - set(known)):
        raise ConfigurationError(f"{path}: a mapping with some of {sorted(known)} is expected{f', not {sorted(unknown)}' if isinstance(given, dict) else ''}")
    return known | given


def command(doc: str, job: Callable[..., DataFrame], read: Callable[[str], Any], paths: Sequence[str], config: Path, argv: Sequence[str] | None) -> int:
    """Runs ``job(session, *paths, settings)`` from the command line; creates the session and stops it."""
    p = argparse.ArgumentParser(description=doc.splitlines()[0])
    for name in paths:
        p.add_argument(f"--{name}", required=True, help=f"path of the {name}, on any file system that Spark reads")
    p.add_argument("--config", default=str(config), help="configuration file (YAML)")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName(job.__module__).getOrCreate()
    try:
        job(spark, *[getattr(args, name) for name in paths], read(args.config))
    finally:
        spark.stop()
    return 0
