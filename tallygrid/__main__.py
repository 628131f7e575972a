"""Command line: ``python -m tallygrid process|analyze|regress|tables|export``.

process  responses, puzzles -> scored trials
analyze  scored trials -> distribution, pair and entropy tables
regress  choice rows (source, item, klass, share and features) -> fits by source, taken up where a run before stopped
tables   tests (test, family, p) -> adjusted tests and their counts
export   responses -> allow-listed columns
Each writes Parquet and a manifest; an existing output is an error, but for the fits.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.answers import resolved_class
from tallygrid.operators import distributions as d
from tallygrid.operators import logit, ordering, scoring, study
from tallygrid.sources import records

RESPONSES = "request_id string, input_kind string, puzzle_id string, trial_ids string, raw_answer string, raw_response string, source string, sample_index int, api_error string"
PUZZLES = ", ".join(f"{k} {v}" for k, v in scoring.PUZZLE.items()) + ", stratum string"


def process(spark: SparkSession, args: argparse.Namespace) -> None:
    responses = records.read_jsonl(spark, args.responses, RESPONSES)
    puzzles = records.read_jsonl(spark, args.puzzles, PUZZLES)
    rows = scoring.ended_without_answer(scoring.scored(scoring.expanded(responses), puzzles))
    rows.join(puzzles.select("puzzle_id", "stratum"), "puzzle_id", "left").write.mode("errorifexists").parquet(f"{args.out}/scored")


def analyze(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = spark.read.parquet(args.scored)
    klass = resolved_class(F.col("is_valid"), F.col("abstract_solution_id"), F.col("solution_id"))
    dist = d.distributions(d.class_counts(rows.select("source", F.col("puzzle_id").alias("item"), klass.alias("klass"), "stratum")))
    pairs = d.pairwise(dist)
    values = ["tv", "js", "js_distance", "hellinger"]
    for name, table in (("distributions", dist), ("pairs", pairs), ("pair_means", d.stratum_means(pairs, ["left", "right"], values)), ("profiles", d.profiles(dist)), ("uniform", d.uniform_baseline(dist))):
        table.write.mode("errorifexists").parquet(f"{args.out}/{name}")


def regress(spark: SparkSession, args: argparse.Namespace) -> None:
    features, draws = args.features.split(","), int(args.draws)
    about = json.dumps(logit.method() | {"features": features, "draws": draws}, sort_keys=True)
    logit.resumed_fits(spark.read.parquet(args.design), "source", about, f"{args.out}/fits", lambda rows: logit.choice_fits(rows, "source", "item", "klass", "share", features, draws, validate=True))


def tables(spark: SparkSession, args: argparse.Namespace) -> None:
    tests = ordering.holm(spark.read.parquet(args.tests), "p", ["test"], ["family"])
    tests.write.mode("errorifexists").parquet(f"{args.out}/adjusted")
    study.significance(tests, ["family"]).write.mode("errorifexists").parquet(f"{args.out}/significance")


def export(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = records.read_jsonl(spark, args.responses, RESPONSES)
    records.write_jsonl(records.exported(rows, args.columns.split(",")), f"{args.out}/export", compressed=True)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallygrid", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name, inputs in (("process", ("responses", "puzzles")), ("analyze", ("scored",)), ("regress", ("design", "features", "draws")), ("tables", ("tests",)), ("export", ("responses", "columns"))):
        command = commands.add_parser(name)
        for option in (*inputs, "out"):
            command.add_argument(f"--{option}", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"tallygrid {args.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    started = time.time()
    {"process": process, "analyze": analyze, "regress": regress, "tables": tables, "export": export}[args.command](spark, args)
    options = {k: v for k, v in vars(args).items() if k != "command"}
    records.write_manifest(spark, f"{args.out}/{args.command}.json", options, {k: v for k, v in options.items() if k in ("responses", "puzzles")}, "done", started)


if __name__ == "__main__":
    main()
