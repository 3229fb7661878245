"""Command line: python -m helixbin.plans.cli {preprocess,learn,cluster,run} [options]; without an action, run."""

from __future__ import annotations

import argparse
import dataclasses
import os
import sys

from pyspark.sql import SparkSession

from helixbin.plans import workflow
from helixbin.plans.config import Config

ACTIONS = ("preprocess", "learn", "cluster", "run")
LISTS = {"alignments": str, "features": str, "tlen_range": int, "compo_neurons": int, "cover_neurons": int}
OPTIONAL = {"fasta": str, "exclude_ids": str, "coverage": str, "vote_threshold": float, "n_clusters": int}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixbin")
    p.add_argument("action", choices=ACTIONS)
    for f in dataclasses.fields(Config):
        flag = "--" + f.name.replace("_", "-")
        if f.name in LISTS:
            p.add_argument(flag, nargs="+", type=LISTS[f.name], default=None)
        elif f.default in (True, False):
            p.add_argument(flag, action="store_true", default=None)
        else:
            p.add_argument(flag, type=OPTIONAL.get(f.name) or type(f.default), default=None)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, **options):
    """Also the Python interface: options override parsed ones, unknown flags are ignored, earlier settings are read back."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or argv[0] not in ACTIONS:
        argv.insert(0, "run")
    args, _ = parser().parse_known_args(argv)
    given = {k: v for k, v in vars(args).items() if v is not None and k != "action"} | options
    saved = f"{given.get('output', Config.output)}/config.json"
    cfg = Config.load(saved, **given) if os.path.exists(saved) else Config(**given)
    spark = spark or SparkSession.builder.appName("helixbin").getOrCreate()
    cfg.save()
    return getattr(workflow, args.action)(spark, cfg)


if __name__ == "__main__":
    main()
