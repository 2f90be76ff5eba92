"""Haplotypes from genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.alleles import MISSING, allele_token, called_tokens, consensus_of, genotype_tokens
from locusframe.functions.ranges import numbered
from locusframe.functions.text import hap_id


def grid(sites: DataFrame, calls: DataFrame, pool: DataFrame | None, complete: bool = False) -> DataFrame:
    """Every pooled sample at every site; gt null where there is no call.

    The grid has as many rows as the calls it completes.  Where the calls are known
    to have a row for every sample at every site, they are the grid: they only get
    the sites' tokens, and are not dealt out; without a pool all of them count.
    """
    if complete:
        named = calls.select("region_ord", "site_ord", "sample", "sample_ord", "gt")
        if pool is not None:
            named = named.join(pool.select("sample"), "sample", "left_semi")
        return named.join(sites.select("region_ord", "site_ord", "tokens"), ["region_ord", "site_ord"])
    cells = pool.select("sample", "sample_ord").crossJoin(sites.select("region_ord", "site_ord", "tokens"))
    return cells.join(calls.select("region_ord", "site_ord", "sample", "gt"), ["region_ord", "site_ord", "sample"], "left")


def ploidy(cells: DataFrame) -> DataFrame:
    """The longest genotype of a sample in a region, one at least."""
    return cells.groupBy("region_ord", "sample").agg(F.greatest(F.max(F.coalesce(F.size("gt"), F.lit(0))), F.lit(1)).alias("ploidy"))


def _sequence(token: Column) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col("site_ord"), token.alias("token"))))
    return F.transform(ordered, lambda s: s["token"])


def sequences(cells: DataFrame, mode: str = "inbred", policy: str = "slash") -> DataFrame:
    """H1, H2: (region_ord, sample, sample_ord, copy, seq)."""
    if mode == "inbred":
        # a column of its own: worked out once a cell, and narrower than what it is made from
        called = called_tokens(genotype_tokens(F.col("tokens"), F.col("gt"))).alias("called")
        token = consensus_of(F.col("called"), policy)
        return cells.select("region_ord", "sample", "sample_ord", "site_ord", called).groupBy("region_ord", "sample", "sample_ord").agg(_sequence(token).alias("seq")).select("region_ord", "sample", "sample_ord", F.lit(0).alias("copy"), "seq")
    if mode != "hybrid":
        raise ValueError(f"unknown mode: {mode}")
    # the copies are read off a sample's whole row, so its cells are grouped and sorted once
    called = F.struct("site_ord", genotype_tokens(F.col("tokens"), F.col("gt")).alias("called"))
    ploid = F.greatest(F.max(F.coalesce(F.size("gt"), F.lit(0))), F.lit(1))
    rows = cells.groupBy("region_ord", "sample", "sample_ord").agg(F.sort_array(F.collect_list(called)).alias("row"), ploid.alias("ploidy"))
    copies = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("ploidy") - 1)).alias("copy"))
    seq = F.transform("row", lambda s: F.coalesce(F.get(s["called"], F.col("copy")), F.lit(MISSING)))
    return copies.select("region_ord", "sample", "sample_ord", "copy", seq.alias("seq"))


def rank(seqs: DataFrame, once: bool = False) -> DataFrame:
    """(region_ord, seq, n, hap_rank, hap).

    Each sample counts once for a sequence; with ``once`` it has one sequence a
    region, and nothing need be made distinct.  Only the distinct sequences of a
    region are ranked, after their counts are combined; many are over range parts.
    """
    own = seqs.select("region_ord", "seq", "sample")
    counted = (own if once else own.distinct()).groupBy("region_ord", "seq").agg(F.count("*").alias("n"))
    return numbered(counted, ["region_ord"], [F.desc("n"), F.asc("seq")], "hap_rank").withColumn("hap", hap_id(F.col("hap_rank")))


def accessions(of_copies: DataFrame) -> DataFrame:
    """H5: (region_ord, hap, accessions) for the summary's text cell."""
    names = F.array_join(F.sort_array(F.collect_set("sample")), ";")
    return of_copies.groupBy("region_ord", "hap").agg(names.alias("accessions"))


def sample_haps(seqs: DataFrame, haps: DataFrame) -> DataFrame:
    """The haplotype of every copy."""
    return seqs.join(haps.select("region_ord", "seq", "hap", "hap_rank"), ["region_ord", "seq"]).drop("seq")


def classes(of_copies: DataFrame, clusters: DataFrame, mode: str = "inbred") -> DataFrame:
    """(region_ord, sample, sample_ord, Hap, ClusterID).

    Inbred samples have one copy a region, which is their class: nothing is grouped.
    """
    both = of_copies.join(clusters.select("region_ord", "hap", "cluster"), ["region_ord", "hap"], "left").withColumn("cluster", F.coalesce("cluster", F.lit("NA")))
    if mode == "inbred":
        return both.select("region_ord", "sample", "sample_ord", F.col("hap").alias("Hap"), F.col("cluster").alias("ClusterID"))
    haps = F.array_sort(F.collect_list("hap"))
    named = both.groupBy("region_ord", "sample", "sample_ord").agg(F.array_join(haps, "_").alias("Hap"), F.array_join(F.array_sort(F.collect_set("cluster")), "_").alias("ClusterID"))
    return named.withColumn("Hap", F.when(F.col("Hap") == "", "NA").otherwise(F.col("Hap")))


def missing_share(cells: DataFrame) -> DataFrame:
    """Called and missing samples of each site."""
    lost = F.forall(genotype_tokens(F.col("tokens"), F.col("gt")), lambda t: t == MISSING)
    return cells.groupBy("region_ord", "site_ord").agg(F.count_if(lost).alias("n_missing"), F.count("*").alias("n_samples"))
