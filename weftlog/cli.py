"""Command line: ingest, train, score, eval."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from weftlog import config as configs


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftlog")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "train", "score", "eval"):
        own = commands.add_parser(name)
        own.add_argument("--config", help="YAML or JSON file over the defaults")
        own.add_argument("--set", dest="overrides", action="append", default=[], metavar="key=value")
        own.add_argument("--detector", help="short for --set detector=...")
    args = parser.parse_args(argv)
    chosen = [f"detector={args.detector}"] if args.detector else []
    config = configs.load(args.config, [*chosen, *args.overrides])

    from weftlog.plans import workflow

    spark = spark or SparkSession.builder.appName("weftlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "ingest":
        ids = workflow.ingest(spark, config)
        print(f"{len(ids)} runs in {configs.get(config, 'data.parquet_dir')}")
    elif args.command == "train":
        print(f"trained {workflow.train(spark, config).name}")
    elif args.command == "score":
        _, found = workflow.score(spark, config)
        print(f"{found.count()} pods scored")
    else:
        print(json.dumps(workflow.evaluate(spark, config), indent=2))
    return 0
