"""What figures show, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.text import feature_name, natural_key
from locusframe.operators.intervals import overlapping

# our own choice of twelve soft colours
PALETTE = ("#8fb8de", "#f2b880", "#a3c9a8", "#e39ba0", "#b7a7d3", "#d9c58b", "#8ecfc9", "#e6a9cf", "#b5b8bd", "#c4dd88", "#9aa9e0", "#e8cfae")
BLOCK_PRIORITY = {"exon": 0, "UTR": 1, "five_prime_UTR": 1, "three_prime_UTR": 1, "CDS": 2}
BLOCK_HEIGHT = {"exon": 0.33, "UTR": 0.24, "five_prime_UTR": 0.24, "three_prime_UTR": 0.24, "CDS": 0.45}


def token_matrix(rows: DataFrame, name: str) -> DataFrame:
    """(region_ord, name, site_ord, token, code): codes in natural order."""
    order = Window.partitionBy("region_ord").orderBy("_k", "token")
    codes = rows.select("region_ord", "token").distinct().withColumn("_k", natural_key(F.col("token"))).select("region_ord", "token", (F.dense_rank().over(order) - 1).alias("code"))
    return rows.join(codes, ["region_ord", "token"]).select("region_ord", name, "site_ord", "token", "code")


def colours(index):
    """M6: a colour by index, repeating after twelve."""
    return F.element_at(F.array(*map(F.lit, PALETTE)), F.pmod(index, F.lit(len(PALETTE))).cast("int") + 1)


def genes(features: DataFrame) -> DataFrame:
    """M1: genes of each region, or one spanning model where there is none."""
    own = features.where("ftype = 'gene'").select("region_ord", "seqid", "start", "stop", "strand", feature_name(F.col("attrs"), F.col("ftype")).alias("name"), "feature_ord", "r_start", "r_stop")
    span = (
        features.groupBy("region_ord", "r_start", "r_stop")
        .agg(F.count_if(F.col("ftype") == "gene").alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("seqid").alias("seqid"))
        .where("n = 0")
        .select("region_ord", "seqid", "start", "stop", F.lit(".").alias("strand"), F.lit("gene_model").alias("name"), F.lit(0).cast("long").alias("feature_ord"), "r_start", "r_stop")
    )
    whole = own.unionByName(span)
    place = Window.partitionBy("region_ord").orderBy("feature_ord")
    return whole.withColumn("y", F.row_number().over(place) - 1).withColumn("line_from", F.greatest("start", "r_start")).withColumn("line_to", F.least("stop", "r_stop"))


def blocks(features: DataFrame, gene_rows: DataFrame) -> DataFrame:
    """Blocks of each gene by coordinates, clipped."""
    style = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("ftype"))
    parts = features.where(F.col("ftype").isin(*BLOCK_PRIORITY)).select("region_ord", "ftype", F.col("start").alias("s"), F.col("stop").alias("e"), "feature_ord", "r_start", "r_stop")
    g = gene_rows.select(F.col("region_ord").alias("_r"), "y", "name", F.col("start").alias("g_start"), F.col("stop").alias("g_stop"))
    both = overlapping(parts, g, [("region_ord", "_r")], ("s", "e"), ("g_start", "g_stop"))
    left, right = F.greatest("s", "r_start"), F.least("e", "r_stop")
    return both.withColumn("left", left).withColumn("right", right).where("right >= left").select(
        "region_ord", "y", "name", "ftype", "left", "right", F.greatest(F.lit(1), F.col("right") - F.col("left") + 1).alias("width"), style(BLOCK_HEIGHT).alias("height"),
        style(BLOCK_PRIORITY).alias("priority"), F.col("s").alias("start"), F.col("e").alias("stop"),
    )


def connectors(sites: DataFrame) -> DataFrame:
    """M5: the matrix column under each variant."""
    order = Window.partitionBy("region_ord").orderBy("site_ord")
    return sites.select("region_ord", "site_ord", "pos", (F.row_number().over(order) - F.lit(0.5)).alias("column"))
