"""Command line: ``python -m kinloom generate|resolve|match|induce ...``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinloom.functions.dictionaries import from_files, from_icu
from kinloom.operators import induce, matching, metrics, nodes
from kinloom.operators.prepare import prepare
from kinloom.plans.resolve import resolve
from kinloom.session import shelve
from kinloom.sources import population, records, results


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Write a synthetic population as CSV."""
    records.write_records(population.generate(spark, a.persons, a.seed), a.out)


def run_resolve(spark: SparkSession, a: argparse.Namespace) -> None:
    """Resolve a CSV of records and write the four result tables and the export."""
    began = time.perf_counter()
    rows = shelve(records.read_records(spark, a.csv), "records")
    rules = records.read_rules(a.rules) if a.rules else None
    found = resolve(rows, _dictionaries(spark, a), rules, a.job)
    took = time.perf_counter() - began
    n = {r["phase"]: r["n"] for r in found.matches.groupBy("phase").agg(F.count("*").alias("n")).collect()}
    stats = results.statistics(spark, [("phase1", found.members.count(), 0, 0, 0.0), *((p, 0, 0, k, 0.0) for p, k in sorted(n.items())), ("total", rows.count(), 0, sum(n.values()), took)])
    results.write(a.out, matches=results.numbered(found.matches), records=rows.drop("idx"), clusters=results.membership(found.members, found.clusters, rows), pipeline_stats=stats)
    judged = metrics.with_truth(found.matches, rows)
    results.export_csv(judged, f"{a.out}/matches_csv")
    metrics.precision_by_phase(judged).orderBy("phase").show(truncate=False)


def _dictionaries(spark: SparkSession, a: argparse.Namespace):
    return from_files(from_icu(spark), strokes=a.strokes, simplified=a.simplified, traditional=a.traditional, jyutping=a.jyutping)


def run_match(spark: SparkSession, a: argparse.Namespace) -> None:
    """Match all records in blocks, without seed clusters; a pair is judged once."""
    d = from_icu(spark)
    p = shelve(prepare(records.read_records(spark, a.csv), d), "prepared")
    matching.match_blocks(p, d, records.read_rules(a.rules) if a.rules else None).write.mode("overwrite").parquet(a.out)


def run_induce(spark: SparkSession, a: argparse.Namespace) -> None:
    """Induce rules from labelled records and write them as JSON."""
    d = from_icu(spark)
    p = shelve(prepare(records.read_sample(spark, a.csv, a.sample), d), "prepared")
    labelled = shelve(labelled_pairs(p, a.negatives, d), "labelled")
    found = induce.induce(labelled, a.mode)
    n = labelled.groupBy("is_match").count().collect()
    about = {("matches_found" if r["is_match"] else "non_matches_found"): r["count"] for r in n}
    records.write_rules(a.out, found, mode=a.mode, source_records=p.count(), **about)


def labelled_pairs(prepared, negatives: int, dictionaries):
    """All pairs of one person and a sample of at most ``negatives`` pairs of different persons, with their features."""
    truth = metrics.truth_pairs(prepared).withColumn("is_match", F.lit(True))
    other = induce.negative_pairs(prepared).orderBy(F.xxhash64("left_id", "right_id")).limit(negatives).withColumn("is_match", F.lit(False))
    a, b = nodes.side(prepared, "a"), nodes.side(prepared, "b")
    pairs = truth.unionByName(other).join(a, F.col("left_id") == F.col("a_record_id")).join(b, F.col("right_id") == F.col("b_record_id"))
    return nodes.all_nodes(pairs, dictionaries)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kinloom", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for name, run, options in (
        ("generate", generate, [("persons", {"type": int}), ("out", {}), ("--seed", {"type": int, "default": 42})]),
        ("resolve", run_resolve, [("csv", {}), ("out", {}), ("--rules", {}), ("--job", {"help": "folder in which a broken run is taken up again"}), ("--strokes", {}), ("--simplified", {}), ("--traditional", {}), ("--jyutping", {})]),
        ("match", run_match, [("csv", {}), ("out", {}), ("--rules", {})]),
        ("induce", run_induce, [("csv", {}), ("out", {}), ("--sample", {"type": int}), ("--negatives", {"type": int, "default": 10000}), ("--mode", {"default": "performance", "choices": ["performance", "audit", "by-phase"]})]),
    ):
        command = commands.add_parser(name, help=run.__doc__)
        for option, more in options:
            command.add_argument(option, **more)
        command.set_defaults(run=run)
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.appName("kinloom").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)


if __name__ == "__main__":
    main()
