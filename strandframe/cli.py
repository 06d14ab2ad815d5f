"""Command line: python -m strandframe.cli COMMAND; see --help."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark import SparkConf
from pyspark.sql import SparkSession

#: Command, help, arguments by position, options.
COMMANDS = {
    "simulate": ("simulate reads and variants of a configuration", ("config",), {}),
    "simulate-circular": ("the same for circular genomes, also from contigs begun at their middle", ("config",), {}),
    "fit-mutations": ("fit a mutation model", ("reference", "vcf", "out"), {"--bed": {}, "--human": {"action": "store_true"}}),
    "fit-fragments": ("fit a model of fragment lengths", ("alignments", "out"), {"--min-reads": {"type": int, "default": 2}}),
    "fit-gc": ("fit weights by GC", ("reference", "alignments", "out"), {"--width": {"type": int, "default": 100}}),
    "fit-errors": ("fit qualities by place and the mean error", ("out", "fastq+"), {"--offset": {"type": int, "default": 33}, "--qualities": {"type": int, "nargs": "+", "default": 42}, "--most": {"type": int}}),
    "fit-qualities": ("fit a quality model, also as a Markov chain", ("out", "fastq+"), {"--offset": {"type": int, "default": 33}, "--qualities": {"type": int, "nargs": "+", "default": 42}, "--most": {"type": int}, "--markov": {"action": "store_true"}, "--preset": {}}),
    "compare": ("compare called variants with the truth of a run", ("truth", "called", "run"), {"--aliases": {}, "--out": {}}),
}


def session() -> SparkSession:
    """The session of spark-submit where there is one; a local one else."""
    from strandframe.session import local_session

    if SparkConf().contains("spark.master"):
        return SparkSession.builder.appName("strandframe").getOrCreate()
    return local_session()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("strandframe")
    out.add_argument("--log-level", default="WARNING")
    commands = out.add_subparsers(dest="command", required=True)
    for name, (text, places, options) in COMMANDS.items():
        one = commands.add_parser(name, help=text)
        for place in places:
            one.add_argument(place.rstrip("+"), **({"nargs": "+"} if place.endswith("+") else {}))
        for option, how in options.items():
            one.add_argument(option, **how)
        one.add_argument("--overwrite", action="store_true", help="replace outputs that are there")
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    from dataclasses import replace

    from strandframe.plans import config, runs
    from strandframe.sources import text as T

    if args.command.startswith("simulate"):
        made = config.read_yaml(args.config)
        return runs.simulate(spark, replace(made, overwrite=made.overwrite or args.overwrite), circular=args.command.endswith("circular"))
    if args.command == "fit-mutations":
        return runs.fit_mutations(spark, args.reference, args.vcf, args.out, args.bed, args.human, args.overwrite)
    if args.command == "fit-fragments":
        return runs.fit_fragments(spark, args.alignments, args.out, args.min_reads, args.overwrite)
    if args.command == "fit-gc":
        return runs.fit_gc(spark, args.reference, args.alignments, args.out, args.width, args.overwrite)
    if args.command in ("fit-errors", "fit-qualities"):
        chain = {"markov": args.markov, "preset": args.preset} if args.command == "fit-qualities" else {}
        return runs.fit_qualities(spark, args.fastq, args.out, args.qualities, args.offset, args.most, overwrite=args.overwrite, **chain)
    aliases = T.read_names(spark, args.aliases) if args.aliases else None
    return runs.compare(spark, args.truth, args.called, config.read_summary(spark, args.run), aliases, args.out, args.overwrite)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level.upper(), format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    print(json.dumps(run(session(), args), indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
