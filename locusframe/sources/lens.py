"""A deterministic genotype reading of the order tables.

Regions are the world regions, sites their nations, samples the customers and
groups their market segments; genotypes follow from the keys.  It gives the
operators a data set of any scale.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import alleles

#: Samples of a part: a cell is made from its sample, so tasks stay small whatever the input.
PART = 20_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites as a variant file would give them, alleles by the site's kind."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    j = F.floor(k / 5.0).cast("int")
    base = lambda d: F.substring(F.lit("ACGT"), F.pmod(k + d, F.lit(4)) + 1, F.lit(1))
    kind = lambda *values: F.element_at(F.array(*values), F.least(F.col("j"), F.lit(4)) + 1)
    both = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("j", j)
    return both.select(
        F.col("r_regionkey").alias("region_ord"), k.cast("long").alias("site_ord"), "j", k.alias("k"), F.col("r_name").alias("chrom"), (100 + 50 * k).cast("long").alias("pos"),
        F.when(k % 2 == 0, F.concat(F.lit("v"), k.cast("string"))).otherwise(".").alias("vid"),
        kind(base(0), base(0), base(0), F.concat(base(0), F.lit("CGT")), base(0)).alias("ref"),
        kind(F.array(base(1)), F.array(F.concat(base(0), F.lit("TG"))), F.array(base(1), base(2)), F.array(base(0)), F.array(base(1), F.lit("<PAV>"))).alias("alts"),
        F.when(F.col("j") == 4, F.lit("SVTYPE=PAV;END=9")).otherwise(".").alias("info"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    svlen = alleles.info_int(alleles.parse_info(F.col("info")), "SVLEN")
    return raw_sites(spark, sf_dir).select(
        "region_ord", "site_ord", "chrom", "pos", alleles.variant_id(F.col("vid"), F.col("chrom"), F.col("pos")).alias("vid"), "ref", "alts",
        alleles.encode_alleles(F.col("ref"), F.col("alts"), svlen).alias("tokens"), "info",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, sample_ord, grp, f1, f2, balance)."""
    key = F.col("c_custkey")
    founders = 3 + F.length("c_mktsegment") % 5
    return _table(spark, sf_dir, "customer").select(
        F.concat(F.lit("S"), F.lpad(key.cast("string"), 8, "0")).alias("sample"), key.alias("sample_ord"), F.col("c_mktsegment").alias("grp"),
        F.pmod(key, founders).alias("f1"), F.when(key % 3 == 0, (key * 5) % 6).otherwise(F.pmod(key, founders)).alias("f2"), F.col("c_acctbal").alias("balance"),
    )


def spread(spark: SparkSession, sf_dir: str, pool: DataFrame | None = None) -> DataFrame:
    """The samples (those of ``pool``), dealt out by their names.

    The customers are a small file that one task reads, but each gives a row for every
    site.  All cells of a sample stay in its part, so grouping by sample moves none.
    """
    rows = samples(spark, sf_dir)
    n = rows.count()
    parts = max(math.ceil(n / PART), min(spark.sparkContext.defaultParallelism, math.ceil(n / 500)), 1)
    rows = rows.repartition(parts, "sample")
    if pool is None:
        return rows
    # part by part: the file is small, but its names are as many as the samples
    return rows.join(pool.select("sample").repartition(parts, "sample").hint("shuffle_hash"), "sample", "left_semi")


def calls(spark: SparkSession, sf_dir: str, pool: DataFrame | None = None) -> DataFrame:
    """(region_ord, site_ord, sample, sample_ord, gt, phased): every cell (of the ``pool``)."""
    s = raw_sites(spark, sf_dir).select("region_ord", "site_ord", "j", "k")
    grid = spread(spark, sf_dir, pool).join(F.broadcast(s))  # sites are the small, fixed side
    j, k = F.col("j"), F.col("k")
    alts = F.when(j.isin(2, 4), 2).otherwise(1)
    allele = lambda f: ((F.col(f) * F.col(f) + F.col(f) * j * (j + 1) + 3 * j + k) % 7 % (alts + 1)).cast("int")
    lost = (F.col("sample_ord") * 31 + k * 17) % 97 == 0
    return grid.select(
        "region_ord", "site_ord", "sample", "sample_ord", F.array(F.when(~lost, allele("f1")), allele("f2")).alias("gt"), (F.col("sample_ord") % 4 != 0).alias("phased")
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("region_ord"), F.col("r_name").alias("chrom"), F.lit(1).cast("long").alias("start"), F.lit(100_000).cast("long").alias("stop")
    )


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lens as variant text: (line, ord), one line per site."""
    gt = F.transform("gt", lambda x: F.coalesce(x.cast("string"), F.lit(".")))
    cells = calls(spark, sf_dir).select("site_ord", "sample_ord", F.when(F.col("phased"), F.array_join(gt, "|")).otherwise(F.array_join(gt, "/")).alias("cell"))
    lined = cells.groupBy("site_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_ord", "cell"))), lambda s: s["cell"]), "\t").alias("cells"))
    s = raw_sites(spark, sf_dir)
    return s.join(lined, "site_ord").select(
        F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "vid", "ref", F.array_join("alts", ","), F.lit("."), F.lit("PASS"), "info", F.lit("GT"), "cells").alias("line"),
        F.col("site_ord").alias("ord"),
    )
