"""The output files of an analysis.

Every kind of file is one relation of lines over all regions: (region_ord, section,
order columns, line), headers and closing lines among them.  Executors write it once
as text parts, dealt out by range and sorted, so the jobs do not grow with the
regions.  A region's parts are then moved together to its file: by renaming where it
has one part, else by the store's own concatenation (HDFS), and where it has none by a
copy from part to part in a fixed buffer.  No line passes through Python here or
there but numbers with a fraction, which are shown in their shortest form.

``outdir`` is a path of the session's file systems (a plain one, or a URI).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.functions.text import file_label

#: Sections of a file: what stands before, in, and behind its body.
HEAD, BODY, TAIL = 0, 1, 2
_BUFFER = 1 << 20


def stem(chrom: str, start: int, stop: int) -> str:
    """The beginning of the names of a region's files."""
    return file_label(f"{chrom}_{start}_{stop}")


@F.pandas_udf(T.StringType())
def shortest(v: pd.Series) -> pd.Series:
    """Numbers with a fraction in the shortest form that reads back; NaN is empty."""
    return v.map(lambda x: "" if x is None or math.isnan(x) else repr(float(x)))


def cell(df: DataFrame, name: str) -> Column:
    """A value as the tables show it: empty for nothing."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind in ("double", "float"):
        return F.coalesce(shortest(c), F.lit(""))
    if kind == "boolean":
        return F.when(c, "True").when(~c, "False").otherwise("")
    return F.coalesce(c.cast("string"), F.lit(""))


def row_line(df: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws("\t", *[cell(df, c) for c in columns])


def heads(regions: DataFrame, *lines: str | Column) -> DataFrame:
    """Header lines of every region; null lines are left out."""
    numbered = F.array(*[F.struct(F.lit(i).alias("at"), (F.lit(x) if isinstance(x, str) else x).alias("line")) for i, x in enumerate(lines)])
    rows = regions.select("region_ord", F.explode(numbered).alias("h"))
    return rows.select("region_ord", F.lit(HEAD).alias("section"), F.col("h.at").alias("at"), F.col("h.line").alias("line")).where("line is not null")


def tails(regions: DataFrame, *lines: str) -> DataFrame:
    return heads(regions, *lines).withColumn("section", F.lit(TAIL))


def body(df: DataFrame, line: Column, *order: str) -> DataFrame:
    """Lines of a body in the order of columns of df."""
    return df.select("region_ord", F.lit(BODY).alias("section"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], line.alias("line"))


def together(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def table(regions: DataFrame, df: DataFrame, columns: dict[str, str], *order: str) -> DataFrame:
    """A table with a header; ``columns``: names in df and in the file."""
    return together(heads(regions, "\t".join(columns.values())), body(df, row_line(df, list(columns)), *order))


# ---------------------------------------------------------------- kinds of files


def processed_variants(regions: DataFrame, sites: DataFrame) -> DataFrame:
    """K1."""
    shown = sites.select("region_ord", "site_ord", F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), F.col("vid").alias("ID"), F.col("ref").alias("REF"), F.array_join("alts", ",").alias("ALT"), F.array_join("tokens", ",").alias("AlleleTokens"))
    return table(regions, shown, {c: c for c in ("CHROM", "POS", "ID", "REF", "ALT", "AlleleTokens")}, "site_ord")


def genotype_tokens(regions: DataFrame, sites: DataFrame, cells: DataFrame, samples: list[str]) -> DataFrame:
    """K2: a line per site, a cell per sample in file order."""
    lined = cells.groupBy("region_ord", "site_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_ord", "cell"))), lambda s: s["cell"]).alias("cells"))
    rows = sites.select("region_ord", "site_ord", "chrom", "pos", "vid").join(lined, ["region_ord", "site_ord"], "left")
    line = F.concat_ws("\t", cell(rows, "chrom"), cell(rows, "pos"), cell(rows, "vid"), F.coalesce(F.array_join("cells", "\t"), F.lit("")))
    return together(heads(regions, "\t".join(["CHROM", "POS", "ID", *samples])), body(rows, line, "site_ord"))


def hap_summary(regions: DataFrame, haps: DataFrame, sites: DataFrame) -> DataFrame:
    """K4: haplotypes in text order under two lines that name the sites."""
    named = sites.groupBy("region_ord").agg(F.array_sort(F.collect_list(F.struct("site_ord", F.col("pos").cast("string").alias("pos"), "chrom"))).alias("s"))
    wide = regions.select("region_ord").join(named, "region_ord", "left")
    lined = lambda first, of, *last: F.concat_ws("\t", F.lit(first), F.transform("s", lambda s: s[of]), F.lit("\t".join(last)))
    top = heads(wide, lined("Hap\tClusterID", "pos", "Accession", "Number"), lined("CHR\t", "chrom", "", "NA"), lined("POS\t", "pos", "", "NA"))
    line = F.concat_ws("\t", "hap", F.coalesce("cluster", F.lit("NA")), "seq", "accessions", F.col("n").cast("string"))
    return together(top, body(haps, line, "hap"))


def _sized(regions: DataFrame, coded: DataFrame, sites: DataFrame) -> DataFrame:
    """(region_ord, taxa, chars, symbols) of every region."""
    taxa = coded.groupBy("region_ord").agg(F.count("*").alias("taxa"))
    signs = coded.select("region_ord", F.explode(F.split("code", "")).alias("c")).where("c <> ''").distinct()
    signs = signs.groupBy("region_ord").agg(F.array_join(F.array_sort(F.collect_list("c")), "").alias("symbols"))
    chars = sites.groupBy("region_ord").agg(F.count("*").alias("chars"))
    whole = regions.select("region_ord").join(taxa, "region_ord", "left").join(chars, "region_ord", "left").join(signs, "region_ord", "left")
    return whole.na.fill({"taxa": 0, "chars": 0, "symbols": "ACGT"})


def fasta(df: DataFrame, name: Column, *order: str) -> DataFrame:
    """Records of a name and a code."""
    return body(df, F.concat(F.lit(">"), name, F.lit("\n"), F.col("code")), *order)


def phylip(regions: DataFrame, coded: DataFrame, sites: DataFrame) -> DataFrame:
    """K7."""
    head = heads(_sized(regions, coded, sites), F.concat_ws(" ", F.col("taxa").cast("string"), F.col("chars").cast("string")))
    return together(head, body(coded, F.concat_ws(" ", "hap", "code"), "hap_rank"))


def nexus(regions: DataFrame, coded: DataFrame, sites: DataFrame) -> DataFrame:
    """K8."""
    size = F.format_string("  DIMENSIONS NTAX=%d NCHAR=%d;", "taxa", "chars")
    form = F.concat(F.lit('  FORMAT DATATYPE=STANDARD SYMBOLS="'), F.col("symbols"), F.lit('" MISSING=N GAP=-;'))
    head = heads(_sized(regions, coded, sites), "#NEXUS", "", "BEGIN DATA;", size, form, "  MATRIX")
    return together(head, body(coded, F.concat(F.lit("  "), F.concat_ws(" ", "hap", "code")), "hap_rank"), tails(regions, "  ;", "END;"))


# ---------------------------------------------------------------- writing


class Folder:
    """A folder of one of the session's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/") or "/"
        self.hadoop = spark._jvm.org.apache.hadoop
        self.conf = spark._jsc.hadoopConfiguration()
        fs = self.of(self.path).getFileSystem(self.conf)
        # a local folder gets no files of checksums
        self.fs = self.hadoop.fs.FileSystem.getLocal(self.conf).getRawFileSystem() if fs.getUri().getScheme() == "file" else fs
        self.fs.mkdirs(self.of(self.path))

    def of(self, path: str):
        return self.hadoop.fs.Path(path)

    def parts(self, path: str) -> list:
        """Text parts under a path, in the order of their numbers."""
        there = self.of(path)
        if not self.fs.exists(there):
            return []
        found = [s.getPath() for s in self.fs.listStatus(there)]
        return sorted((p for p in found if p.getName().startswith("part-")), key=lambda p: p.getName())

    def gather(self, parts: list, name: str) -> str:
        """The parts as one file."""
        path = f"{self.path}/{name}"
        target = self.of(path)
        self.fs.delete(target, False)
        if not parts:
            self.fs.create(target, True).close()
            return path
        first, *rest = parts
        if rest and not self._concatenated(first, rest):
            out = self.fs.create(target, True)
            try:
                for p in parts:
                    source = self.fs.open(p)
                    try:
                        self.hadoop.io.IOUtils.copyBytes(source, out, _BUFFER, False)
                    finally:
                        source.close()
            finally:
                out.close()
        else:
            self.fs.rename(first, target)
        return path

    def _concatenated(self, first, rest: list) -> bool:
        # other stores lack it, or take it to replace the first part
        if self.fs.getUri().getScheme() != "hdfs":
            return False
        array = self.spark.sparkContext._gateway.new_array(self.hadoop.fs.Path, len(rest))
        for i, p in enumerate(rest):
            array[i] = p
        self.fs.concat(first, array)
        return True


def write_files(spark: SparkSession, outdir: str, kinds: dict[str, tuple[str, DataFrame]], regions: Iterable) -> dict[int, dict[str, str]]:
    """{region_ord: {kind: path}}; ``kinds``: ending of the file names and lines.

    One job a kind, whatever the number of regions.
    """
    folder = Folder(spark, outdir)
    scratch = f"{folder.path}/_parts-{uuid.uuid4().hex}"
    regions = list(regions)
    paths: dict[int, dict[str, str]] = {r["region_ord"]: {} for r in regions}
    try:
        for kind, (ending, lines) in kinds.items():
            order = ["region_ord", *[c for c in lines.columns if c not in ("region_ord", "line")]]
            order.sort(key=lambda c: (c != "region_ord", c != "section", c))
            sorted_ = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("region_ord", "line")
            sorted_.write.partitionBy("region_ord").text(f"{scratch}/{kind}")
            for r in regions:
                name = stem(r["chrom"], r["start"], r["stop"]) + ending
                paths[r["region_ord"]][kind] = folder.gather(folder.parts(f"{scratch}/{kind}/region_ord={r['region_ord']}"), name)
    finally:
        folder.fs.delete(folder.of(scratch), True)
    return paths
