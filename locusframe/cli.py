"""The command line."""

from __future__ import annotations

import argparse
import sys

from locusframe import __version__
from locusframe.functions.text import csv_list
from locusframe.plans.engine import Engine, Options
from locusframe.sources.readers import BACKENDS
from locusframe.sources.scratch import scope


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locusframe", description="Regional haplotype analysis on Spark")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest", help="variant text to Parquet, of which regions are read without the rest")
    i.add_argument("--vcf", required=True)
    i.add_argument("--out", required=True)
    for name in ("prepare", "analyze"):
        c = sub.add_parser(name)
        c.add_argument("--vcf", required=True)
        c.add_argument("--region")
        c.add_argument("--region-file")
        c.add_argument("--outdir", required=True)
        c.add_argument("--vcf-backend", default="auto", choices=BACKENDS)
    c.add_argument("--group", "--group-file", dest="group_file", required=True)
    c.add_argument("--traits", "--trait-file", dest="trait_file")
    c.add_argument("--gff", "--gff-file", dest="gff_file")
    c.add_argument("--mode", default="inbred", choices=("inbred", "hybrid"))
    c.add_argument("--hetero-policy", default="slash", choices=("slash", "iupac", "missing"))
    c.add_argument("--fisher-groups", help="two group names between commas")
    c.add_argument("--fisher-alpha", type=float)
    c.add_argument("--fisher-adjust", default="none", choices=("none", "bh"))
    c.add_argument("--cluster-threshold", type=float, default=0.15)
    c.add_argument("--no-processed", action="store_true")
    c.add_argument("--plot", action="store_true")
    c.add_argument("--plot-format", default="pdf", help="formats between commas; each figure is written as its data table, and a warning says so")
    c.add_argument("--trait-cols")
    c.add_argument("--plot-hap-level", default="hap", choices=("hap", "cluster"))
    c.add_argument("--plot-min-count", type=int, default=1)
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    groups = csv_list(getattr(a, "fisher_groups", None))
    if groups is not None and len(groups) != 2:
        p.error("--fisher-groups needs exactly two names")

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("locusframe").getOrCreate()
    if a.command == "ingest":
        from locusframe.sources.readers import ingest

        ingest(spark, a.vcf, a.out)
        print(a.out)
        return 0
    with scope():  # all results are in files at its end
        return _run(Engine(spark), a, groups)


def _run(engine: Engine, a: argparse.Namespace, groups: list[str] | None) -> int:
    if a.command == "prepare":
        for pair in engine.prepare(a.vcf, a.outdir, a.region, a.region_file, a.vcf_backend):
            print(*pair, sep="\n")
        return 0
    options = Options(
        a.mode, a.hetero_policy, tuple(groups) if groups else None, a.fisher_alpha, a.fisher_adjust, a.cluster_threshold, a.vcf_backend, not a.no_processed, True,
        csv_list(a.trait_cols), a.plot_hap_level, a.plot_min_count,
    )
    if a.plot:
        print(f"figures ({', '.join(csv_list(a.plot_format) or [])}) are written as data tables", file=sys.stderr)
    result = engine.analyze(a.vcf, a.group_file, a.outdir, a.region, a.region_file, a.trait_file, a.gff_file, options, a.plot)
    for ord_, paths in sorted(result.paths.items()):
        print(f"region {ord_}")
        for name, path in paths.items():
            print(f"  {name}: {path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
