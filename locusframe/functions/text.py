"""Names, keys and attribute parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: feature types by their lower-case aliases
FEATURE_TYPES = {
    "gene": "gene", "mrna": "mRNA", "transcript": "transcript", "exon": "exon", "cds": "CDS", "utr": "UTR",
    "five_prime_utr": "five_prime_UTR", "5utr": "five_prime_UTR", "5_prime_utr": "five_prime_UTR",
    "three_prime_utr": "three_prime_UTR", "3utr": "three_prime_UTR", "3_prime_utr": "three_prime_UTR",
}
# fixed values: attributes that name a feature, the first one found counts
NAME_KEYS = ("Name", "gene", "gene_name", "ID", "locus_tag")


def hap_id(n: Column) -> Column:
    """Hap001, and more digits from 1000 on."""
    return F.format_string("Hap%03d", n)


def natural_key(text: Column) -> Column:
    """Digit runs padded, so that text order is natural order."""
    padded = F.transform(
        F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)
    )
    return F.array_join(padded, "")


def split_composite(token: Column) -> Column:
    """P20: the parts of a joined token."""
    return F.when(token.isin("", "NA"), F.array().cast("array<string>")).otherwise(F.filter(F.split(token, "/"), lambda x: x != ""))


def significance(p: Column) -> Column:
    """Stars for a p-value."""
    return F.when(p.isNull() | F.isnan(p), "NA").when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("ns")


def gff_attributes(text: Column) -> Column:
    """``k=v`` and ``k "v"`` items to a map, the last repeat wins."""
    items = F.filter(F.transform(F.split(text, ";"), lambda s: F.trim(s)), lambda s: s.contains("=") | s.contains(" "))
    pairs = F.transform(
        items,
        lambda s: F.when(s.contains("="), F.struct(F.substring_index(s, "=", 1).alias("key"), s.substr(F.instr(s, "=") + 1, F.length(s)).alias("value"))).otherwise(
            F.struct(F.substring_index(s, " ", 1).alias("key"), F.regexp_replace(s.substr(F.instr(s, " ") + 1, F.length(s)), '^"+|"+$', "").alias("value"))
        ),
    )
    keys = F.transform(pairs, lambda p: p["key"])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"]))
    return F.map_from_entries(last)


def feature_type(raw: Column) -> Column:
    """The usual spelling of a feature type."""
    names = F.create_map(*[F.lit(x) for kv in FEATURE_TYPES.items() for x in kv])
    return F.coalesce(names[F.lower(raw)], raw)


def feature_name(attrs: Column, ftype: Column) -> Column:
    """The first naming attribute, else the type."""
    return F.coalesce(*[attrs[k] for k in NAME_KEYS], ftype)


def csv_list(text: str | None) -> list[str] | None:
    """A comma list option; None when it holds nothing."""
    items = [x.strip() for x in (text or "").split(",") if x.strip()]
    return items or None


def file_label(text: str) -> str:
    """Text that is safe in a file name."""
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", text)


def level_column(level: str) -> str:
    """P25: the class column of a plot level."""
    columns = {"hap": "Hap", "cluster": "ClusterID"}
    if level not in columns:
        raise ValueError(f"unknown level {level!r}: use hap or cluster")
    return columns[level]


def level_stem(level: str, stem: str) -> str:
    """The file stem of a plot level."""
    level_column(level)
    if stem == "GeneHaplotype":
        return ".GeneHaplotype" if level == "hap" else ".GeneClusterHaplotype"
    return f".{stem}" if level == "hap" else f".Cluster{stem}"
