"""Command line: ``python -m markerloom COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from markerloom.operators.merge import merge
from markerloom.operators.process import process
from markerloom.sources import readers, writers
from markerloom.types import Correction, MarkerError, Test, single


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="markerloom", description="Marker-by-individual depth analytics.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("-o", "--output", required=True)
        if "t" in options:
            p.add_argument("-t", "--table", required=True)
        if "p" in options:
            p.add_argument("-p", "--popmap", required=True)
        if "d" in options:
            p.add_argument("-d", "--min-depth", type=int, default=1)
        if "G" in options:
            p.add_argument("-G", "--groups", help="two names, with a comma between them")
        if "S" in options:
            p.add_argument("-S", "--threshold", type=float, default=0.05)
        if "C" in options:
            p.add_argument("-C", "--no-correction", action="store_true")
        if "m" in options:
            p.add_argument("--correction", default="bonferroni")
            p.add_argument("--test", default="chisq")
        return p

    p = command("process", "d")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-T", "--threads", type=int, default=1, help="local Spark threads")
    p.add_argument("-k", "--kmer-dedup", type=int)
    command("distrib", "t", "p", "d", "G", "S", "C", "m")
    p = command("signif", "t", "p", "d", "G", "S", "C", "m")
    p.add_argument("-a", "--fasta", action="store_true")
    p.add_argument("--bayes", action="store_true")
    p = command("triage", "t", "p", "d", "G", "S")
    for name, value in (("posterior-threshold", 0.9), ("bayes-factor-threshold", 10.0), ("prior-probability", 0.01), ("linked-probability", 0.9)):
        p.add_argument(f"--{name}", type=float, default=value)
    command("freq", "t", "d")
    p = command("depth", "t", "p")
    p.add_argument("-f", "--min-frequency", type=float, default=0.75)
    p = command("map", "t", "p", "d", "G", "S", "C")
    p.add_argument("-g", "--genome", required=True)
    p.add_argument("-q", "--min-quality", type=int, default=20)
    p.add_argument("-Q", "--min-frequency", type=float, default=0.1)
    p = command("subset", "t", "p", "d", "G", "C", "m")
    p.add_argument("-a", "--fasta", action="store_true")
    for low, high, name in (("m", "M", "group1"), ("n", "N", "group2"), ("i", "I", "total")):
        p.add_argument(f"-{low}", f"--min-{name}", type=int, default=0)
        p.add_argument(f"-{high}", f"--max-{name}", type=int, default=9999)
    p = command("merge")
    p.add_argument("tables", nargs="+")
    p.add_argument("--output-parquet", action="store_true")
    p = command("pca", "t", "d")
    p.add_argument("-r", "--components", type=int)
    return top


def group_pair(text: str | None) -> dict:
    if text is None:
        return {}
    names = [x.strip() for x in text.split(",")]
    if len(names) != 2 or not all(names):
        raise MarkerError("-G takes two names with a comma between them")
    return {"group1": names[0], "group2": names[1]}


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    a = vars(args)
    if args.command == "process":
        people = readers.individuals_of(spark, args.input)
        table = process(readers.read_fastx(spark, args.input), people, min_depth=args.min_depth, kmer_dedup=args.kmer_dedup)
        return writers.write_markers(table, args.output)
    if args.command == "merge":
        table = merge([readers.read_marker_tsv(spark, t) for t in args.tables])
        return writers.write_parquet(table, args.output) if args.output_parquet else writers.write_markers(table, args.output)
    popmap = readers.read_popmap(spark, args.popmap) if a.get("popmap") else ()
    table = readers.read_marker_tsv(spark, args.table, popmap)
    pair = group_pair(a.get("groups"))
    common = {"min_depth": args.min_depth, **pair} if "min_depth" in a else {}
    method = {}
    if "correction" in a:
        method = {"correction": Correction.NONE if args.no_correction else Correction.of(args.correction), "test": Test.of(args.test)}
    meta = {"source": args.command, **{k: a[k] for k in ("min_depth", "threshold", "test") if k in a}}
    if args.command == "distrib":
        df = table.distrib(**common, **method, threshold=args.threshold)
        writers.write_tsv(df, args.output, metadata=meta, order=df.columns[:2])
    elif args.command in ("signif", "subset"):
        if args.command == "signif":
            df = table.signif(**common, **method, threshold=args.threshold, bayes=args.bayes)
        else:
            df = table.subset(**common, **method, range1=(args.min_group1, args.max_group1), range2=(args.min_group2, args.max_group2), total=(args.min_total, args.max_total), statistics=True, depths=True)
        if args.fasta:
            writers.write_fasta_file(df, args.output, table.groups(**pair), args.min_depth)
        else:
            more = [c for c in ("Bayes_Factor", "Posterior_SexLinked") if c in df.columns]
            rows = df.orderBy("ord").select("id", "sequence", *["depths"] * bool(table.individuals), *more)
            writers.write_tsv(rows, args.output, metadata={k: str(v) for k, v in meta.items()}, columns=["id", "sequence", *table.individuals, *more], decimals=4)
    elif args.command == "triage":
        df = table.triage(**common, threshold=args.threshold, posterior_threshold=args.posterior_threshold, bayes_factor_threshold=args.bayes_factor_threshold, prior=args.prior_probability, linked=args.linked_probability)
        writers.write_tsv(df, args.output, metadata=meta, lower_booleans=True)
    elif args.command == "freq":
        writers.write_tsv(table.freq(min_depth=args.min_depth), args.output, metadata=meta, order=["Frequency"])
    elif args.command == "depth":
        writers.write_tsv(table.depth(min_frequency=args.min_frequency, strict=True), args.output)
    elif args.command == "map":
        df = table.map(readers.read_genome_pieces(spark, args.genome), **common, threshold=args.threshold, correction="none" if args.no_correction else "bonferroni", min_quality=args.min_quality, min_frequency=args.min_frequency)
        writers.write_tsv(df, args.output, metadata={**meta, "threshold": single(args.threshold)}, order=["Contig", "Position"])
    elif args.command == "pca":
        writers.write_pca(table.pca(min_depth=args.min_depth, components=args.components), args.output)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "process" and args.threads > 1 and spark is None:
        spark = SparkSession.builder.master(f"local[{args.threads}]").getOrCreate()
    try:
        run(args, spark or SparkSession.builder.appName("markerloom").getOrCreate())
    except MarkerError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
