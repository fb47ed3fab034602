"""Command line: ``python -m tessera.plans.cli draft|correct|partition``."""

from __future__ import annotations

import argparse
import logging
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import pipelines as P
from tessera.sources import binary, text

log = logging.getLogger("tessera")


def leading_int(text: str) -> int:
    """The whole number that a text begins with, 0 without one, as the programs read their options."""
    found = re.match(r"\s*[+-]?\d+", text, re.ASCII)
    return int(found[0]) if found else 0


def leading_float(text: str) -> float:
    """The number that a text begins with, 0 without one."""
    found = re.match(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", text, re.ASCII)
    return float(found[0]) if found else 0.0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    sub = top.add_subparsers(dest="program", required=True)
    d = sub.add_parser("draft", help="sequences and alignments to a weighted contact graph")
    c = sub.add_parser("correct", help="sequences cut where contacts are depleted")
    for p in (d, c):
        p.add_argument("-f", "--fasta", required=True)
        p.add_argument("-m", "--mapping", nargs="+", required=True)
        p.add_argument("-o", "--output", required=True)
        p.add_argument("--name-mode", choices=("line", "first_token"), default="line")
    d.add_argument("-e", "--enzyme", required=True)
    d.add_argument("-q", "--mapq", type=leading_int, default=40)
    d.add_argument("-r", "--enzyme-range", type=leading_int, default=1000, help="whole width of a site's window")
    d.add_argument("-c", "--min-sites", type=leading_int, default=0)
    c.add_argument("-p", "--percent", type=leading_float, default=0.95)
    c.add_argument("-s", "--sensitivity", type=leading_float, default=0.5)
    c.add_argument("-q", "--mapq", type=leading_int, default=1)
    c.add_argument("-w", "--wide", type=leading_int, default=25_000)
    c.add_argument("-n", "--narrow", type=leading_int, default=1_000)
    c.add_argument("-d", "--depletion", type=leading_int, default=100_000)
    g = sub.add_parser("partition", help="contigs in groups by their edges")
    g.add_argument("-n", "--nodes", required=True, help="contig table: Parquet, or .bin for the flat form")
    g.add_argument("-e", "--edges", required=True, help="edge table: Parquet, or .bin for the flat form")
    g.add_argument("-g", "--groups", type=leading_int, required=True)
    g.add_argument("-a", "--allele-groups", type=leading_int, default=-1)
    g.add_argument("-x", "--allele-table")
    g.add_argument("-o", "--output", required=True)
    for p in (d, c, g):
        p.add_argument("-t", "--threads", type=leading_int, default=1, help="taken for compatibility; Spark's session decides")
    return top


def _table(spark: SparkSession, path: str, flat) -> DataFrame:
    return flat(spark, path) if path.endswith(".bin") else spark.read.parquet(path)


def run(spark: SparkSession, argv: Sequence[str]) -> None:
    args = parser().parse_args(argv)
    if args.program == "partition":
        config = P.PartitionConfig(args.groups, args.allele_groups)
        contigs = _table(spark, args.nodes, binary.read_contigs)
        if args.allele_table and args.allele_groups != -1:
            text.allele_table(text.read_lines(spark, args.allele_table), contigs, args.allele_groups).write.parquet(f"{args.output}.alleles")
        P.partition(contigs, _table(spark, args.edges, binary.read_edges), config).write.parquet(f"{args.output}.groups")
        return
    contigs = text.read_fasta(spark, args.fasta, args.name_mode)
    records = binary.read_mapping(spark, args.mapping)
    if args.program == "draft":
        made = P.draft(contigs, records, P.DraftConfig(args.enzyme, args.mapq, args.enzyme_range >> 1, args.min_sites))
        for name in ("contigs", "invalid", "read_pairs", "edges"):
            getattr(made, name).write.parquet(f"{args.output}.{name}")
            log.info("%s.%s written", args.output, name)
        return
    config = P.CorrectConfig(args.percent, args.sensitivity, args.mapq, args.wide, args.narrow, args.depletion)
    text.write_fasta(P.correct(contigs, records, config), args.output)


def main() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    run(SparkSession.builder.appName("tessera").getOrCreate(), None)


if __name__ == "__main__":
    main()
