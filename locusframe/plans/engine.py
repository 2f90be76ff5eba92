"""Whole analyses.  All regions go through one plan."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.alleles import genotype_tokens
from locusframe.functions.text import level_column, level_stem
from locusframe.operators import association, clustering, encoding, haplotypes, plotdata, traits
from locusframe.sources import readers, sinks
from locusframe.sources.scratch import cut, discard


#: Frames of the gene figure.
GENE_FIGURE = ("genes", "blocks", "connectors")


class EmptyRegion(ValueError):
    """A region without variants, or without any after the site test."""


@dataclass
class Options:
    mode: str = "inbred"
    hetero_policy: str = "slash"
    fisher_groups: tuple[str, str] | None = None
    fisher_alpha: float | None = None
    fisher_adjust: str = "none"
    cluster_threshold: float = 0.15
    vcf_backend: str = "auto"
    write_processed: bool = True
    strict: bool = True
    trait_cols: list[str] | None = None
    level: str = "hap"
    min_count: int = 1


@dataclass
class Result:
    """The relations of an analysis, keyed by region_ord."""

    regions: DataFrame
    sites: DataFrame
    cells: DataFrame
    haps: DataFrame
    copies: DataFrame
    clusters: DataFrame
    hap_group: DataFrame
    states: DataFrame
    fisher: DataFrame | None
    trait_names: list[str]
    options: Options
    samples: list[str] = field(default_factory=list)
    paths: dict[int, dict[str, str]] = field(default_factory=dict)


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    # ---------------------------------------------------------- relations

    def located(self, vcf: str, regions: DataFrame, backend: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Header, sites and calls of the regions."""
        header = readers.read_header(self.spark, vcf)
        records = readers.in_regions(readers.read_variants(self.spark, vcf, backend, regions), regions)
        return header, readers.sites_of(records), readers.calls_of(records, header, header.count())

    def _present(self, regions: DataFrame, sites: DataFrame, why: str) -> None:
        empty = regions.join(sites, "region_ord", "left_anti").orderBy("region_ord").limit(1).collect()
        if empty:
            r = empty[0]
            raise EmptyRegion(f"{why} in {r['chrom']}:{r['start']}-{r['stop']}")

    def relations(self, regions: DataFrame, header: DataFrame, sites: DataFrame, calls: DataFrame, groups: DataFrame, trait_table: DataFrame | None, o: Options) -> Result:
        """The lazy relations; the actions are the checks the inputs need.

        ``calls`` have a row for every sample of the header at every site.
        """
        pool = readers.pool(header, groups)
        if pool.isEmpty():
            raise readers.InputError("no sample of the variants is in the group file")
        if o.strict:
            self._present(regions, sites, "no variants")
        fisher = None
        if o.fisher_groups and o.fisher_alpha is not None:
            fisher = association.fisher_table(sites, calls, groups, *o.fisher_groups, o.fisher_alpha, o.fisher_adjust)
            fisher = cut(fisher)
            sites = association.keep_sites(sites, fisher)
            if o.strict:
                self._present(regions, sites, "no variants left after the site test")
        elif o.fisher_groups:
            warnings.warn("site test groups without an alpha: sites are not filtered", stacklevel=2)
        cells = haplotypes.grid(sites, calls, pool, complete=True)
        seqs = cut(haplotypes.sequences(cells, o.mode, o.hetero_policy))
        haps = cut(haplotypes.rank(seqs))
        copies = cut(haplotypes.sample_haps(seqs, haps))
        member = cut(clustering.clusters(haps, o.cluster_threshold))
        named = haplotypes.classes(copies, member, o.mode)
        group = named.join(groups, "sample", "left").select("region_ord", "sample_ord", "Hap", "ClusterID", F.col("sample").alias("Accession"), F.coalesce("grp", F.lit("NA")).alias("Type"))
        names: list[str] = []
        if trait_table is not None:
            table = readers.unique_accessions(trait_table)
            names = [c for c in table.columns if c != "Accession"]
            group = group.join(table, "Accession", "left")
        group = cut(group.select("region_ord", "Hap", "ClusterID", "Accession", "Type", *names))
        return Result(regions, sites, cells, haps, copies, member, group, cut(encoding.state_map(haps)), fisher, names, o)

    # ---------------------------------------------------------- analyses

    def analyze(self, vcf: str, group_file: str, outdir: str, region: str | None = None, region_file: str | None = None, trait_file: str | None = None, gff_file: str | None = None, options: Options | None = None, plots: bool = False) -> Result:
        o = options or Options()
        level_column(o.level)
        regions = cut(readers.read_regions(self.spark, region, region_file))
        groups = cut(readers.read_groups(self.spark, group_file))
        header, sites, calls = self.located(vcf, regions, o.vcf_backend)
        trait_table = readers.read_traits(self.spark, trait_file) if trait_file else None
        # parsed once: every later step reads these
        sites, calls = cut(sites), cut(calls.join(groups.select("sample"), "sample", "left_semi"))
        result = self.relations(regions, header, sites, calls, groups, trait_table, o)
        pooled = readers.pool(header, groups).orderBy("sample_ord").collect()
        result.samples = [r["sample"] for r in pooled]
        # tests and figures of all regions are computed once, and read region by region
        values = self.trait_values(result) if trait_file else None
        report = cut(traits.report(values, ["region_ord"], o.level)) if trait_file else None
        features = readers.read_annotation(self.spark, gff_file) if plots and gff_file else None
        figures = {k: cut(df) for k, df in self.plot_data(result, features, values, report).items()} if plots else {}
        kinds = self._files(result, report)
        kinds |= {k if k not in kinds else f"figure_{k}": v for k, v in self._figure_files(result, figures).items()}
        result.paths = sinks.write_files(self.spark, outdir, kinds, regions.orderBy("region_ord").collect())
        return result

    def prepare(self, vcf: str, outdir: str, region: str | None = None, region_file: str | None = None, backend: str = "auto") -> list[tuple[str, str]]:
        """Site and genotype tables of all samples; empty regions are left out."""
        regions = cut(readers.read_regions(self.spark, region, region_file))
        header, sites, calls = self.located(vcf, regions, backend)
        sites, calls = cut(sites), cut(calls)
        cells = haplotypes.grid(sites, calls, header, complete=True)
        names = [r["sample"] for r in header.orderBy("sample_ord").collect()]
        full = regions.join(sites, "region_ord", "left_semi").orderBy("region_ord")
        paths = sinks.write_files(self.spark, outdir, self._processed_files(full, sites, cells, names), full.collect())
        discard(sites)
        discard(calls)
        return [(p["variants"], p["genotypes"]) for p in paths.values()]

    def plot_data(self, result: Result, features: DataFrame | None = None, values: DataFrame | None = None, report: DataFrame | None = None) -> dict[str, DataFrame]:
        """What each figure shows, as frames over all regions.

        ``values`` and ``report`` are those of the traits, if they are known.
        """
        o = result.options
        column = level_column(o.level)
        sized = clustering.cluster_sizes(result.copies, result.clusters).where(F.col("n") >= o.min_count)
        if o.level == "cluster":
            tokens = clustering.consensus_tokens(result.haps, result.clusters, result.sites).join(sized.drop("n"), ["region_ord", "cluster"], "left_semi")
            name = "cluster"
        else:
            place = result.sites.select("region_ord", "site_ord", (F.row_number().over(_sites_in_order()) - 1).alias("at"))
            shown = result.haps.where(F.col("n") >= o.min_count).select("region_ord", "hap", F.posexplode("seq").alias("at", "token"))
            tokens, name = shown.join(place, ["region_ord", "at"]).select("region_ord", "hap", "site_ord", "token"), "hap"
        table = traits.crosstab(result.hap_group, column, "Type", ["region_ord"], o.min_count)
        table = table.withColumn("colour", plotdata.colours(F.col("ord") - 1))
        matrix = plotdata.token_matrix(tokens, name).withColumn("colour", plotdata.colours(F.col("code")))
        out = {"matrix": matrix, "proportions": table, "pies": traits.pie_slices(table, "Type", ["region_ord"]), "connectors": plotdata.connectors(result.sites)}
        if features is not None:
            near = readers.features_in(features, result.regions)
            genes = plotdata.genes(near)
            out |= {"genes": genes, "blocks": plotdata.blocks(near, genes)}
        if result.trait_names:
            values = self.trait_values(result) if values is None else values
            report = traits.report(values, ["region_ord"], o.level) if report is None else report
            out |= {"boxes": traits.box_stats(values, ["region_ord"]), "points": traits.jitter_points(values), "significance": report, "annotations": traits.top_annotations(report, ["region_ord"])}
        return out

    def trait_values(self, result: Result) -> DataFrame:
        wanted = result.options.trait_cols
        names = [n for n in result.trait_names if wanted is None or n in wanted]
        values = traits.long_traits(result.hap_group, level_column(result.options.level), names, ["region_ord"], result.options.min_count)
        return cut(values)  # read by every test

    # ---------------------------------------------------------- files

    def _processed_files(self, regions: DataFrame, sites: DataFrame, cells: DataFrame, names: list[str]) -> dict[str, tuple[str, DataFrame]]:
        shown = cells.select("region_ord", "site_ord", "sample_ord", F.array_join(genotype_tokens(F.col("tokens"), F.col("gt")), "/").alias("cell"))
        return {
            "variants": (".ProcessedVariants.tsv", sinks.processed_variants(regions, sites)),
            "genotypes": (".SampleGenotypeTokens.tsv", sinks.genotype_tokens(regions, sites, shown, names)),
        }

    def _files(self, x: Result, report: DataFrame | None) -> dict[str, tuple[str, DataFrame]]:
        """The endings and lines of the files of all regions."""
        out: dict[str, tuple[str, DataFrame]] = {}
        if x.fisher is not None:
            g1, g2 = x.options.fisher_groups
            names = {"chrom": "CHROM", "pos": "POS", "vid": "ID", "a": f"{g1}_ALT", "b": f"{g1}_REF", "c": f"{g2}_ALT", "d": f"{g2}_REF", "pvalue": "pvalue", "padj": "padj", "keep": "keep"}
            out["fisher"] = ".FisherFilter.tsv", sinks.table(x.regions, x.fisher, names, "site_ord")
        if x.options.write_processed:
            out |= self._processed_files(x.regions, x.sites, x.cells, x.samples)
        rows = x.haps.join(x.clusters, ["region_ord", "hap"], "left").join(haplotypes.accessions(x.copies), ["region_ord", "hap"])
        out["summary"] = ".HapSummary.tsv", sinks.hap_summary(x.regions, rows, x.sites)
        out["group"] = ".HapGroup.tsv", sinks.table(x.regions, x.hap_group, {c: c for c in ("Hap", "ClusterID", "Accession", "Type", *x.trait_names)}, "Accession")
        coded = cut(encoding.encode(x.haps, x.states))
        out["fasta"] = ".Haplotype.fa", sinks.fasta(coded, F.col("hap"), "hap_rank")
        out["phylip"] = ".Haplotype.phy", sinks.phylip(x.regions, coded, x.sites)
        out["nexus"] = ".Haplotype.nex", sinks.nexus(x.regions, coded, x.sites)
        place = x.sites.select("region_ord", "chrom", "pos", (F.row_number().over(_sites_in_order()) - 1).alias("at"))
        states = x.states.join(place, ["region_ord", "at"])
        out["states"] = ".AlleleStateMap.tsv", sinks.table(x.regions, states, {"chrom": "CHROM", "pos": "POS", "token": "OriginalToken", "state": "EncodedState"}, "at", "state")
        copies = x.copies.select("region_ord", "sample", "sample_ord", "copy", "hap").join(coded.select("region_ord", "hap", "code"), ["region_ord", "hap"])
        copy = [] if x.options.mode == "inbred" else [F.concat(F.lit("copy"), (F.col("copy") + 1).cast("string"))]
        out["sample_fasta"] = ".Haplotype_sample.fa", sinks.fasta(copies, F.concat_ws("|", "sample", *copy, "hap"), "sample_ord", "copy")
        if report is not None:
            shown = report.withColumn("second", F.col("ComparisonType") == "pairwise").withColumnRenamed("trait", "Trait")
            own = [c for c in shown.columns if c not in ("region_ord", "trait_ord", "ord1", "ord2", "second")]
            out["significance"] = level_stem(x.options.level, "TraitSignificance.tsv"), sinks.table(x.regions, shown, {c: c for c in own}, "trait_ord", "second", "ord1", "ord2")
        return out

    def _figure_files(self, x: Result, figures: dict[str, DataFrame]) -> dict[str, tuple[str, DataFrame]]:
        """Each figure's data as a table beside the results."""
        out = {}
        for name, df in figures.items():
            flat = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
            out[name] = level_stem(x.options.level, "GeneHaplotype" if name in GENE_FIGURE else "plot") + f"_{name}.tsv", sinks.table(x.regions, df, {c: c for c in flat})
        return out


def _sites_in_order():
    from pyspark.sql import Window

    return Window.partitionBy("region_ord").orderBy("site_ord")
