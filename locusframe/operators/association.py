"""Association of sites with two groups of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.statistics import benjamini_hochberg, fisher_exact

BH_NAMES = ("bh", "fdr", "padj", "adjusted")


def carrier_counts(calls: DataFrame, groups: DataFrame, g1: str, g2: str) -> DataFrame:
    """per site a, b (first group with and without ALT) and c, d (second).

    A sample counts once; one without a called allele does not count.  If both
    names are the same all samples are in the first group.
    """
    called = calls.select("region_ord", "site_ord", "sample", F.filter("gt", lambda x: x >= 0).alias("called")).where(F.size("called") > 0)
    carrier = F.exists("called", lambda x: x > 0)
    own = called.join(groups.where(F.col("grp").isin(g1, g2)), "sample")
    first, second = F.col("grp") == g1, (F.col("grp") == g2) & (F.col("grp") != g1)
    return own.groupBy("region_ord", "site_ord").agg(
        F.count_if(first & carrier).alias("a"), F.count_if(first & ~carrier).alias("b"), F.count_if(second & carrier).alias("c"), F.count_if(second & ~carrier).alias("d")
    )


def fisher_table(sites: DataFrame, calls: DataFrame, groups: DataFrame, g1: str, g2: str, alpha: float, adjust: str = "none") -> DataFrame:
    """Every site with counts, pvalue, padj and keep.

    The test runs once for each distinct table.
    """
    counts = sites.select("region_ord", "site_ord", "chrom", "pos", "vid").join(carrier_counts(calls, groups, g1, g2), ["region_ord", "site_ord"], "left").na.fill(0, ["a", "b", "c", "d"])
    tables = counts.select("a", "b", "c", "d").distinct().withColumn("pvalue", fisher_exact(*map(F.col, "abcd")))
    tested = counts.join(tables, ["a", "b", "c", "d"])
    if adjust.lower() in BH_NAMES:
        tested = benjamini_hochberg(tested, "pvalue", "padj", ["region_ord"])
    else:
        tested = tested.withColumn("padj", F.col("pvalue"))
    return tested.withColumn("keep", F.col("padj") <= alpha)


def keep_sites(sites: DataFrame, tested: DataFrame) -> DataFrame:
    return sites.join(tested.where("keep").select("region_ord", "site_ord"), ["region_ord", "site_ord"], "left_semi")
