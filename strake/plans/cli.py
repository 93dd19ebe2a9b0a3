"""Command line: ``python -m strake.plans.cli sort -I DIR... -O DIR``, and ``validate -O DIR``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from ..operators import validation
from .job import SortJob, run


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strake")
    sub = p.add_subparsers(dest="command", required=True)
    sort = sub.add_parser("sort", help="order the records of some folders")
    sort.add_argument("-I", "--input", nargs="+", required=True)
    sort.add_argument("-O", "--output", required=True)
    sort.add_argument("--workers", type=int, default=1)
    sort.add_argument("-p", "--partitions", type=int)
    sort.add_argument("--strategy", choices=("A", "B"), default="B")
    sort.add_argument("--rule", choices=("coordinator", "balanced"), default="coordinator")
    sort.add_argument("--sample", choices=("blocks", "bernoulli", "systematic", "prefix"), default="blocks")
    sort.add_argument("--rate", type=float, default=0.01)
    sort.add_argument("--format", dest="kind", choices=("auto", "binary", "ascii"), default="auto")
    sort.add_argument("--overwrite", action="store_true")
    sort.add_argument("--checkpoint-dir")
    sort.add_argument("--id", dest="job_id")
    sort.add_argument("--seed", type=int)
    sort.add_argument("--attempts", type=int, default=2)
    sort.add_argument("--replicate", action="store_true", help="keep the sample on two executors")
    sort.add_argument("--progress", action="store_true", help="say every second how far the stages are")
    sort.add_argument("--validate", action="store_true")
    check = sub.add_parser("validate", help="check a sorted folder")
    check.add_argument("-O", "--output", required=True)
    return p


def main(args: list[str] | None = None) -> int:
    given = vars(parser().parse_args(args))
    command = given.pop("command")
    own = SparkSession.getActiveSession() is None
    spark = SparkSession.builder.appName("strake").getOrCreate()
    try:
        if command == "validate":
            done = validation.report(spark, given["output"])
            print(json.dumps(done))
            return int(not (done["sorted"] and done["ordered"]))
        say = (lambda p: print(json.dumps(p), file=sys.stderr)) if given.pop("progress") else None
        print(json.dumps(run(spark, SortJob(inputs=given.pop("input"), **given), say)))
        return 0
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
