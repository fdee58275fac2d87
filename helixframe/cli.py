"""Command line over text matrices: reheader, subset, split-genotype."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from helixframe.sources import matrices


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("reheader", help="name a matrix's samples, and its sites where positions are given")
    a.add_argument("data", help="counts (with --pos) or likelihoods")
    a.add_argument("names", help="a sample name a line")
    a.add_argument("out")
    a.add_argument("--pos", help="positions, a line for each of the counts")
    a = sub.add_parser("subset", help="keep listed sites and samples of a named matrix")
    a.add_argument("data")
    a.add_argument("out")
    a.add_argument("--snps", help="a site a line")
    a.add_argument("--samples", help="a sample name a line")
    a = sub.add_parser("split-genotype", help="split counts by called genotype")
    a.add_argument("likelihoods")
    a.add_argument("counts")
    a.add_argument("prefix")
    a.add_argument("--site-stats", help="table with snpcode and MAF")
    a.add_argument("--maf-threshold", type=float, default=0.05)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "reheader" and args.pos:
        matrices.reheader_counts(spark, args.data, args.pos, args.names, args.out)
    elif args.command == "reheader":
        matrices.reheader_likelihoods(spark, args.data, args.names, args.out)
    elif args.command == "subset":
        matrices.subset(spark, args.data, args.out, args.snps, args.samples)
    else:
        matrices.split_genotype(spark, args.likelihoods, args.counts, args.prefix, args.site_stats, args.maf_threshold)


if __name__ == "__main__":
    main()
