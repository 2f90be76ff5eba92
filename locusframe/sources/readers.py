"""Scans: variant calls, sample groups, traits, regions, gene annotation.

Text is read with ``spark.read.text`` (gzip included) and parsed by column
expressions; block-compressed text and binary variants come from ``blocks``, many
tasks a file and by the index beside it.  Variant text can be ingested once to Parquet by chromosome, sorted
by position (``ingest``); the intervals of a short region list are literals of the
scan, so other chromosomes' files and row groups of other places are not read.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions import alleles, text
from locusframe.operators.intervals import overlapping
from locusframe.sources import blocks

REGION_SCHEMA = "region_ord int, chrom string, start long, stop long"
VARIANT_SUFFIXES = (".vcf", ".vcf.gz", ".vcf.bgz")
RECORD_SCHEMA = "ord long, pos long, vid string, ref string, alts array<string>, info string, fmt string, cells array<string>, chrom string"
#: Regions, or chromosomes of a longer list, that become literals of a scan.
MOST_LITERALS = 200


BACKENDS = ("auto", "cyvcf2", "pysam", "plain", "parquet")


class InputError(ValueError):
    """An input that does not have the expected form."""


def variant_format(path: str, wanted: str = "auto") -> str:
    """The format of a path; a named one is taken as it is.

    The names of indexed readers are accepted: binary and block-compressed files
    are read range by range, with the index beside them if there is one; others are
    read from the text, or from the ingested table, by the same region predicate.
    """
    if wanted not in BACKENDS:
        raise InputError(f"unknown variant backend {wanted!r}; use one of {', '.join(BACKENDS)}")
    if wanted in ("plain", "parquet"):
        return wanted
    if path.endswith(".bcf"):
        if not blocks.is_block_compressed(path):
            raise InputError(f"{path}: no block-compressed binary variants, or in a store that cannot be opened here")
        return "bcf"
    if not path.endswith(VARIANT_SUFFIXES):
        return "parquet"
    return "blocks" if path.endswith("gz") and blocks.is_block_compressed(path) else "plain"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place in the file: (line, ord)."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id().alias("ord"))


def parse_region(spec: str) -> tuple[str, int, int]:
    """``chrom:start-end``, both ends included."""
    m = re.fullmatch(r"([^:]+):(\d+)-(\d+)", spec.strip())
    if not m or int(m[2]) < 1 or int(m[3]) < int(m[2]):
        raise InputError(f"region {spec!r} is not chrom:start-end with 1 <= start <= end")
    return m[1], int(m[2]), int(m[3])


def read_regions(spark: SparkSession, region: str | None = None, region_file: str | None = None) -> DataFrame:
    """The named region and those of the file, in this order."""
    if not region and not region_file:
        raise InputError("give a region or a region file")
    parts = []
    if region:
        parts.append(spark.createDataFrame([(-1, *parse_region(region))], "ord long, chrom string, start long, stop long"))
    if region_file:
        f = F.split("line", "\t")
        rows = _lines(spark, region_file).where((F.trim("line") != "") & ~F.col("line").startswith("#"))
        bad = rows.where((F.size(f) < 3) | F.exists(F.slice(f, 1, 3), lambda x: x == "") | F.get(f, F.lit(1)).try_cast("long").isNull() | F.get(f, F.lit(2)).try_cast("long").isNull())
        if not bad.isEmpty():
            raise InputError(f"{region_file}: each line needs chrom, start and end between tabs")
        parts.append(rows.select("ord", f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("stop")))
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # the list of regions is short by nature: one task numbers it
    return whole.select((F.row_number().over(Window.orderBy("ord")) - 1).cast("int").alias("region_ord"), "chrom", "start", "stop")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(sample, grp); the last line of a sample counts."""
    f = F.split("line", "\t")
    rows = _lines(spark, path).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    if not rows.where((F.size(f) < 2) | (f[0] == "") | (F.get(f, F.lit(1)) == "")).isEmpty():
        raise InputError(f"{path}: each line needs a sample and a group between tabs")
    out = rows.groupBy(f[0].alias("sample")).agg(F.max_by(f[1], "ord").alias("grp"))
    if out.isEmpty():
        raise InputError(f"{path}: no samples")
    return out


def read_traits(spark: SparkSession, path: str) -> DataFrame:
    """Trait table; the first column is the accession, read as text."""
    wide = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=True)
    if len(wide.columns) < 2:
        raise InputError(f"{path}: a trait table needs two columns at least")
    schema = ", ".join(f"`{c}` {'string' if i == 0 else t}" for i, (c, t) in enumerate(wide.dtypes))
    out = spark.read.csv(path, sep="\t", header=True, comment="#", schema=schema)
    return out.withColumnRenamed(out.columns[0], "Accession")


def unique_accessions(traits: DataFrame) -> DataFrame:
    """The table, if every accession stands once."""
    twice = traits.groupBy("Accession").count().where("count > 1").limit(1).collect()
    if twice:
        raise InputError(f"accession {twice[0][0]!r} stands twice in the trait table")
    return traits


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(sample_ord, sample) of the header line."""
    if variant_format(path) in ("blocks", "bcf"):
        names = blocks.read_head(path).samples
    else:
        header = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()
        if not header:
            raise InputError(f"{path}: no #CHROM header")
        names = header[0][0].rstrip("\r\n").split("\t")[9:]
    if len(set(names)) != len(names):
        raise InputError(f"{path}: a sample name stands twice in the header")
    return spark.createDataFrame(list(enumerate(names)), "sample_ord int, sample string")


def parse_records(lines: DataFrame) -> DataFrame:
    """Lines to records with an array of sample cells."""
    f = F.split("line", "\t")
    rows = lines.where(~F.col("line").startswith("#")).select("ord", f.alias("f")).where(F.size("f") >= 8)
    at = lambda i: F.get("f", F.lit(i))
    return rows.select(
        "ord", at(0).alias("chrom"), at(1).cast("long").alias("pos"), at(2).alias("vid"), at(3).alias("ref"),
        F.split(at(4), ",").alias("alts"),
        at(7).alias("info"), F.coalesce(at(8), F.lit("")).alias("fmt"),
        F.when(F.size("f") > 9, F.slice("f", 10, F.size("f"))).otherwise(F.array().cast("array<string>")).alias("cells"),
    )


def read_variants(spark: SparkSession, path: str, fmt: str = "auto", regions: DataFrame | None = None, range_bytes: int = blocks.RANGE_BYTES) -> DataFrame:
    """Records (ord, chrom, pos, vid, ref, alts, info, fmt, cells).

    With ``regions``, a block-compressed or binary file with an index beside it is
    read only where the index says that their records are; records outside the
    regions may come with them.
    """
    kind = variant_format(path, fmt)
    if kind == "parquet":
        return spark.read.schema(RECORD_SCHEMA).parquet(path)
    if kind == "plain":
        return parse_records(_lines(spark, path))
    found = blocks.read(spark, path, kind == "bcf", None if regions is None else _spans(regions)[0], range_bytes)
    return found if kind == "bcf" else parse_records(found)


def ingest(spark: SparkSession, path: str, out: str) -> None:
    """Records as Parquet by chromosome, sorted by position: regions prune."""
    records = read_variants(spark, path)
    records.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", "ord").write.partitionBy("chrom").mode("overwrite").parquet(out)


def _spans(regions: DataFrame) -> tuple[list[tuple[str, int, int]] | None, bool]:
    """The regions, or where they are many one span a chromosome (None beyond a
    bound); whether they are many."""
    spans = regions.select("chrom", "start", "stop").limit(MOST_LITERALS + 1).collect()
    many = len(spans) > MOST_LITERALS
    if many:
        spans = regions.groupBy("chrom").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).limit(MOST_LITERALS + 1).collect()
    return ([(r["chrom"], r["start"], r["stop"]) for r in spans] if len(spans) <= MOST_LITERALS else None), many


def _reach(spans: list[tuple[str, int, int]] | None) -> Column:
    """A literal predicate that holds in every region, so that scans can prune."""
    if spans is None:
        return F.lit(True)
    return functools.reduce(Column.__or__, [(F.col("chrom") == c) & F.col("pos").between(a, z) for c, a, z in spans], F.lit(False))


def in_regions(records: DataFrame, regions: DataFrame) -> DataFrame:
    """Records by region; positions only, both ends included."""
    spans, many = _spans(regions)
    r = regions.select("region_ord", F.col("chrom").alias("_c"), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    near = records.where(_reach(spans))
    if many:
        found = overlapping(near, r, [("chrom", "_c")], ("pos", "pos"), ("_start", "_stop"))
    else:  # no more than MOST_LITERALS rows
        found = near.join(F.broadcast(r), (F.col("chrom") == F.col("_c")) & F.col("pos").between(F.col("_start"), F.col("_stop")))
    return found.drop("_c", "_start", "_stop")


def sites_of(records: DataFrame) -> DataFrame:
    """Sites with tokens (P1-P6), keyed by region and file order."""
    svlen = alleles.info_int(alleles.parse_info(F.col("info")), "SVLEN")
    return records.select(
        "region_ord", F.col("ord").alias("site_ord"), "chrom", "pos", alleles.variant_id(F.col("vid"), F.col("chrom"), F.col("pos")).alias("vid"),
        "ref", "alts", alleles.encode_alleles(F.col("ref"), F.col("alts"), svlen).alias("tokens"), "info",
    )


def calls_of(records: DataFrame, header: DataFrame, samples: int | None = None) -> DataFrame:
    """One row per site and sample cell.

    With the number of samples of the header, also a row for every sample that a
    short line leaves out, with a null gt.
    """
    cells = F.col("cells")
    if samples is not None:
        cells = F.concat(cells, F.array_repeat(F.lit(None).cast("string"), F.greatest(F.lit(samples) - F.size("cells"), F.lit(0))))
    cell = records.select("region_ord", F.col("ord").alias("site_ord"), "fmt", F.posexplode(cells).alias("sample_ord", "cell"))
    named = cell.join(header, "sample_ord")
    there = lambda c: F.when(F.col("cell").isNotNull(), c(F.col("fmt"), F.col("cell")))
    return named.select("region_ord", "site_ord", "sample", "sample_ord", there(alleles.decode_genotype).alias("gt"), there(alleles.is_phased).alias("phased"))


# fixed values: feature types that are shown
SHOWN = ("gene", "mRNA", "transcript", "exon", "CDS", "UTR", "five_prime_UTR", "three_prime_UTR")


def parse_annotation(lines: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Annotation lines to features."""
    f = F.split("line", "\t")
    rows = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).select(F.col(ord_col).alias("feature_ord"), f.alias("f")).where(F.size("f") >= 9)
    at = lambda i: F.get("f", F.lit(i))
    return rows.select(
        "feature_ord", at(0).alias("seqid"), at(3).cast("long").alias("start"), at(4).cast("long").alias("stop"), at(6).alias("strand"),
        text.feature_type(at(2)).alias("ftype"), text.gff_attributes(at(8)).alias("attrs"),
    )


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    return parse_annotation(_lines(spark, path))


def features_in(features: DataFrame, regions: DataFrame) -> DataFrame:
    """Shown features that overlap a region."""
    r = regions.select("region_ord", "chrom", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    shown = features.where(F.col("ftype").isin(*SHOWN))
    if _spans(regions)[1]:
        return overlapping(shown, r, [("seqid", "chrom")], ("start", "stop"), ("r_start", "r_stop")).drop("chrom")
    on = (shown["seqid"] == r["chrom"]) & (shown["stop"] >= r["r_start"]) & (shown["start"] <= r["r_stop"])
    return shown.join(F.broadcast(r), on).drop("chrom")


def pool(header: DataFrame, groups: DataFrame) -> DataFrame:
    """Samples of the calls that have a group, in file order."""
    return header.join(groups, "sample", "left_semi")
