"""One character for each token of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the order in which free characters are taken
STATES = "ACGTNRYSWKMBDHV0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN = ("A", "C", "G", "T", "N")


def state_map(haps: DataFrame) -> DataFrame:
    """(region_ord, at, token, state) of every site of the sequences.

    Single bases and N keep themselves; other tokens, in order, take the first
    characters that no base of the site uses.  A site with more tokens than
    characters raises.
    """
    free = F.array_distinct(F.array(*map(F.lit, STATES)))
    plain = F.array(*map(F.lit, PLAIN))
    per_site = haps.select("region_ord", F.posexplode("seq").alias("at", "token")).groupBy("region_ord", "at").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    named = per_site.select(
        "region_ord", "at", F.array_intersect("tokens", plain).alias("own"), F.array_except("tokens", plain).alias("others")
    ).withColumn("open", F.array_except(free, F.col("own")))
    checked = F.when(F.size("others") <= F.size("open"), F.col("others")).otherwise(
        F.raise_error(F.concat(F.lit("more token states than characters at site "), F.col("at").cast("string")))
    )
    entries = F.concat(
        F.transform("own", lambda t: F.struct(t.alias("token"), t.alias("state"))),
        F.transform(checked, lambda t, i: F.struct(t.alias("token"), F.get("open", i).alias("state"))),
    )
    return named.select("region_ord", "at", F.explode(entries).alias("e")).select("region_ord", "at", "e.token", "e.state")


def encode(haps: DataFrame, states: DataFrame) -> DataFrame:
    """(region_ord, hap, hap_rank, code)."""
    long = haps.select("region_ord", "hap", "hap_rank", F.posexplode("seq").alias("at", "token")).join(states, ["region_ord", "at", "token"])
    ordered = F.array_sort(F.collect_list(F.struct("at", "state")))
    return long.groupBy("region_ord", "hap", "hap_rank").agg(F.array_join(F.transform(ordered, lambda s: s["state"]), "").alias("code"))


def symbols(states: DataFrame) -> DataFrame:
    """(region_ord, symbols): the characters used, ACGT if none."""
    used = F.array_join(F.array_sort(F.collect_set("state")), "")
    return states.groupBy("region_ord").agg(F.when(used == "", "ACGT").otherwise(used).alias("symbols"))
