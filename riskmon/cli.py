"""Command line: prepare, train, replay and try a challenger, over Parquet folders."""

from __future__ import annotations

import argparse
import json
import uuid
from dataclasses import asdict

from pyspark.sql import SparkSession

from riskmon import config
from riskmon.operators import lifecycle
from riskmon.plans import catalogue, preparation, replay
from riskmon.session import importable
from riskmon.sources import export, ingest

CAPPED, AMOUNT = ["product"], ["amount"]


def try_challenger(spark: SparkSession, source: str, bundle: str, target: str, s: config.Settings) -> str:
    """Evaluate a challenger against a saved bundle; writes its figures and the segments to a new folder."""
    champion = lifecycle.load(spark, bundle)
    made = lifecycle.engineer(preparation.transactions(spark, source, s), *champion.asked)
    trial = lifecycle.evaluate_challenger(made, champion, champion.asked[0], CAPPED, s.label_delay, s.iterations, s.minimum_positive, s.minimum_negative)
    path = f"{target.rstrip('/')}/trial-{uuid.uuid4().hex[:8]}"
    trial.summary.write.parquet(f"{path}/summary")
    trial.segments.write.parquet(f"{path}/segments")
    return path


def monitor(spark: SparkSession, source: str, bundle: str, target: str, s: config.Settings) -> dict[str, str]:
    """Run the monitoring of all batches, and of the later rows where they were prepared; the paths of the tables by name."""
    champion, version = lifecycle.load(spark, bundle), preparation.data_version(ingest.read_manifest(spark, f"{source}/manifest"))
    rows, later = preparation.transactions(spark, source, s), None
    if export.present(spark, f"{source}/test.parquet"):
        later = preparation.transactions(spark, source, s, "test")
        later = later.select(*[c for c in later.columns if c in (*rows.columns, "shadow_batch")])
    return replay.run(spark, rows, champion, target, champion.asked[0], CAPPED, AMOUNT, s, later, version)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="riskmon", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all registered queries")
    one = commands.add_parser("query", help="run one query and print its first rows")
    one.add_argument("name", choices=sorted(catalogue.QUERIES))
    one.add_argument("source")
    for name, what, places in (
        ("show-config", "check the settings and print them", []), ("prepare", "check CSV tables and write them as Parquet with a manifest", ["source", "target"]),
        ("train", "tune, fit and judge a champion", ["source", "target"]), ("replay", "run the monitoring of all batches and of later rows", ["source", "bundle", "target"]),
        ("retrain-eval", try_challenger.__doc__, ["source", "bundle", "target"]),
    ):
        command = commands.add_parser(name, help=what)
        command.add_argument("--config")
        for place in places:
            command.add_argument(place)
    return out


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    if given.command == "list":
        print("\n".join(catalogue.QUERIES))
        return 0
    settings = config.load(getattr(given, "config", None))
    if given.command == "show-config":
        print(json.dumps(asdict(settings), indent=2))
        return 0
    spark = importable(SparkSession.builder.getOrCreate())
    if given.command == "query":
        catalogue.QUERIES[given.name](spark, given.source).show(50, truncate=False)
    elif given.command == "prepare":
        preparation.prepare(spark, given.source, given.target, settings)
    elif given.command == "train":
        print(preparation.train(spark, given.source, given.target, settings))
    elif given.command == "retrain-eval":
        print(try_challenger(spark, given.source, given.bundle, given.target, settings))
    else:
        print(json.dumps(monitor(spark, given.source, given.bundle, given.target, settings), indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
