"""Registered queries: the operators over the genotype lens of the tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import alleles, text
from locusframe.operators import association, clustering, encoding, haplotypes, plotdata, traits
from locusframe.sources import lens, readers
from locusframe.sources.scratch import cut

G1, G2 = "BUILDING", "AUTOMOBILE"
ALPHA, THRESHOLD, MIN_COUNT = 0.05, 0.2, 20
TRAITS = ["balance", "score"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and doubles at six places, for comparison."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "double":
            c = F.round(c, 6)
        cols.append(c.alias(name))
    return df.select(*cols)


class Lens:
    """The lens' relations and what follows from them, built once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str, mode: str = "inbred", policy: str = "slash"):
        self.spark, self.sf_dir, self.mode = spark, sf_dir, mode
        self.sites = lens.sites(spark, sf_dir)
        self.calls = lens.calls(spark, sf_dir)
        self.samples = lens.samples(spark, sf_dir)
        self.groups = self.samples.select("sample", "grp")
        # the pool: samples that have a group
        self.cells = haplotypes.grid(F.broadcast(self.sites), lens.calls(spark, sf_dir, self.groups), None, complete=True)
        self.seqs = haplotypes.sequences(self.cells, mode, policy)

    # ranks need a job, so only queries that read them have it
    @functools.cached_property
    def haps(self) -> DataFrame:
        return haplotypes.rank(self.seqs, once=self.mode == "inbred")

    @functools.cached_property
    def copies(self) -> DataFrame:
        return haplotypes.sample_haps(self.seqs, self.haps)

    def written(self) -> Lens:
        """The sequences as a table: for queries that rank them and read them again."""
        self.seqs = cut(self.seqs)
        return self

    def clustered(self, threshold: float = THRESHOLD) -> DataFrame:
        self.written()
        self.haps = cut(haplotypes.rank(self.seqs, once=self.mode == "inbred"))
        self.copies = haplotypes.sample_haps(self.seqs, self.haps)
        # written, so that few haplotypes are known to be few and broadcast to their copies
        return cut(clustering.clusters(self.haps, threshold))

    def tested(self, adjust: str = "bh") -> DataFrame:
        return association.fisher_table(self.sites, self.calls, self.groups, G1, G2, ALPHA, adjust)

    def traits(self) -> DataFrame:
        """Every sample has its row; a tenth has no values, and the score leans on the founder."""
        known = lambda v: F.when(F.col("sample_ord") % 10 != 0, v)
        score = (F.col("sample_ord") * 7 % 100 + 20 * F.col("f1")).cast("double")
        return self.samples.select(F.col("sample").alias("Accession"), known(F.col("balance")).alias("balance"), known(score).alias("score"))

    def named(self) -> DataFrame:
        member = self.clustered()
        return haplotypes.classes(self.copies, member, self.mode)

    def typed(self) -> DataFrame:
        # every sample has its group and traits: dealt out by sample, not broadcast
        return self.named().join(self.groups.hint("merge"), "sample", "left").withColumn("Type", F.coalesce("grp", F.lit("NA")))

    def valued(self, named: DataFrame) -> DataFrame:
        return named.join(self.traits().withColumnRenamed("Accession", "sample").hint("merge"), "sample", "left")

    def hap_group(self) -> DataFrame:
        return self.valued(self.typed()).select("region_ord", "sample_ord", "Hap", "ClusterID", F.col("sample").alias("Accession"), "Type", *TRAITS)

    # tables of groups need no traits, and tests of traits no groups: a sample has one row in each
    def crosstab(self) -> DataFrame:
        return traits.crosstab(self.typed(), "ClusterID", "Type", ["region_ord"], MIN_COUNT)

    def values(self) -> DataFrame:
        # read by every test: computed once; the classes are counted before they meet the traits
        named = self.named()
        return cut(traits.long_traits(self.valued(named), "ClusterID", TRAITS, ["region_ord"], MIN_COUNT, counted=named))


@query
def q01_region_scan(spark, sf_dir):
    one = lens.regions(spark, sf_dir).where("chrom = 'ASIA'").withColumn("start", F.lit(200).cast("long")).withColumn("stop", F.lit(800).cast("long"))
    records = lens.raw_sites(spark, sf_dir).drop("region_ord").withColumnRenamed("site_ord", "ord")
    return plain(readers.in_regions(records, one).select("chrom", "pos", "ref"))


@query
def q02_multi_region_union(spark, sf_dir):
    r = lens.regions(spark, sf_dir)
    low, high = r.withColumn("stop", F.lit(700).cast("long")), r.withColumn("start", F.lit(500).cast("long")).withColumn("region_ord", F.col("region_ord") + 5)
    records = lens.raw_sites(spark, sf_dir).drop("region_ord").withColumnRenamed("site_ord", "ord")
    return plain(readers.in_regions(records, low.unionByName(high)).groupBy("region_ord").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last")))


def _parsed(spark, sf_dir):
    records = readers.parse_records(lens.vcf_lines(spark, sf_dir))
    header = lens.samples(spark, sf_dir)
    # cell places count from zero in the order of the samples' keys
    low = header.agg(F.min("sample_ord").alias("low"))
    named = header.join(F.broadcast(low)).select((F.col("sample_ord") - F.col("low")).cast("int").alias("sample_ord"), "sample")
    located = readers.in_regions(records, lens.regions(spark, sf_dir))
    return readers.sites_of(located), readers.calls_of(located, named)


@query
def q03_vcf_roundtrip(spark, sf_dir):
    sites, calls = _parsed(spark, sf_dir)
    both = calls.join(sites.select("region_ord", "site_ord", "chrom", "pos"), ["region_ord", "site_ord"])
    n = lambda c: F.count_if(c)
    g1, g2 = F.get("gt", F.lit(0)), F.get("gt", F.lit(1))
    return plain(both.groupBy("chrom", "pos").agg(n(g1 == 0).alias("ref1"), n(g1 > 0).alias("alt1"), n(g1.isNull()).alias("lost1"), n(g2 > 0).alias("alt2")))


@query
def q04_info_parse(spark, sf_dir):
    k = F.col("n_nationkey")
    info = F.when(k % 5 == 0, F.lit(".")).otherwise(F.concat(F.lit("SVLEN=-"), k.cast("string"), F.lit(",7;END=x=y;SVLEN="), (k * 3).cast("string"), F.lit(";;FLAG")))
    m = alleles.parse_info(info)
    return plain(
        spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("k"), m["END"].alias("ending"), m["FLAG"].alias("flag"), alleles.info_int(m, "SVLEN").alias("svlen"), F.size(m).alias("n"))
    )


@query
def q05_allele_tokens(spark, sf_dir):
    return plain(lens.sites(spark, sf_dir).select("chrom", "pos", "vid", "ref", F.array_join("alts", ",").alias("alt"), F.array_join("tokens", ",").alias("tokens")))


@query
def q06_symbolic_tokens(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ("<DEL>", "<absent>", "<DUP:TANDEM>", "<present>", "<PAV>", "<X>", "<>", "*", "", "ACGT"))), F.pmod(F.col("p_partkey"), F.lit(10)).cast("int") + 1)
    svlen = F.when(F.col("p_size") % 3 == 0, F.col("p_size") - 24)
    token = alleles.alt_token(F.lit("A"), names, svlen.cast("int"))
    return plain(spark.read.parquet(f"{sf_dir}/part.parquet").select(names.alias("alt"), token.alias("token")).groupBy("alt", "token").agg(F.count("*").alias("n")))


@query
def q07_genotype_tokens(spark, sf_dir):
    cells = Lens(spark, sf_dir).cells.select("site_ord", F.array_join(alleles.genotype_tokens(F.col("tokens"), F.col("gt")), "/").alias("cell"))
    return plain(cells.groupBy("site_ord", "cell").agg(F.count("*").alias("n")))


@query
def q08_ploidy(spark, sf_dir):
    return plain(haplotypes.ploidy(Lens(spark, sf_dir).cells).groupBy("region_ord", "ploidy").agg(F.count("*").alias("n")))


@query
def q09_phased_share(spark, sf_dir):
    calls = _parsed(spark, sf_dir)[1]
    return plain(calls.groupBy("site_ord").agg(F.count_if("phased").alias("n_phased"), (F.count_if("phased") / F.count("*")).alias("share")))


@query
def q10_sample_pool(spark, sf_dir):
    s = lens.samples(spark, sf_dir)
    groups = s.where("grp <> 'MACHINERY'").select("sample", "grp")
    return plain(readers.pool(s.select("sample", "sample_ord"), groups).select("sample", "sample_ord"))


@query
def q11_missingness(spark, sf_dir):
    return plain(haplotypes.missing_share(Lens(spark, sf_dir).cells))


def _consensus(policy):
    def run(spark, sf_dir):
        called = alleles.called_tokens(alleles.genotype_tokens(F.col("tokens"), F.col("gt")))
        cells = Lens(spark, sf_dir).cells.select("site_ord", called.alias("called"))
        return plain(cells.select("site_ord", alleles.consensus_of(F.col("called"), policy).alias("token")).groupBy("site_ord", "token").agg(F.count("*").alias("n")))

    return run


for _policy, _name in (("slash", "q12_consensus_slash"), ("iupac", "q13_consensus_iupac"), ("missing", "q14_consensus_missing")):
    QUERIES[_name] = _consensus(_policy)


@query
def q15_carrier_counts(spark, sf_dir):
    x = Lens(spark, sf_dir)
    return plain(association.carrier_counts(x.calls, x.groups, G1, G2))


@query
def q16_fisher(spark, sf_dir):
    return plain(Lens(spark, sf_dir).tested("none").select("region_ord", "site_ord", "pvalue"))


@query
def q17_bh(spark, sf_dir):
    return plain(Lens(spark, sf_dir).tested("bh").select("region_ord", "site_ord", "pvalue", "padj"))


@query
def q18_fisher_keep(spark, sf_dir):
    x = Lens(spark, sf_dir)
    return plain(association.keep_sites(x.sites, x.tested("bh")).select("region_ord", "site_ord", "vid"))


def _haps(mode):
    def run(spark, sf_dir):
        x = Lens(spark, sf_dir, mode)
        return plain(x.haps.select("region_ord", "hap", "n", F.array_join("seq", " ").alias("seq")))

    return run


QUERIES["q19_haps_inbred"] = _haps("inbred")
QUERIES["q20_haps_hybrid"] = _haps("hybrid")


@query
def q21_hap_membership(spark, sf_dir):
    return plain(Lens(spark, sf_dir, "hybrid").written().copies.select("region_ord", "sample", "copy", "hap"))


@query
def q22_hamming_pairs(spark, sf_dir):
    x = Lens(spark, sf_dir)
    return plain(clustering.links(x.haps, THRESHOLD))


@query
def q23_clusters(spark, sf_dir):
    return plain(Lens(spark, sf_dir).clustered())


@query
def q24_cluster_consensus(spark, sf_dir):
    x = Lens(spark, sf_dir)
    member = x.clustered()
    return plain(clustering.consensus_tokens(x.haps, member, x.sites).join(clustering.cluster_sizes(x.copies, member, once=True), ["region_ord", "cluster"]))


@query
def q25_hap_summary(spark, sf_dir):
    x = Lens(spark, sf_dir)
    member = x.clustered()
    rows = x.haps.join(member, ["region_ord", "hap"], "left").join(haplotypes.accessions(x.copies), ["region_ord", "hap"])
    return plain(rows.select("region_ord", F.col("hap").alias("Hap"), F.coalesce("cluster", F.lit("NA")).alias("ClusterID"), F.array_join("seq", " ").alias("seq"), F.col("accessions").alias("Accession"), F.col("n").alias("Number")))


@query
def q26_hap_group_traits(spark, sf_dir):
    return plain(Lens(spark, sf_dir).hap_group().drop("sample_ord"))


@query
def q27_diplotype_classes(spark, sf_dir):
    x = Lens(spark, sf_dir, "hybrid")
    member = x.clustered()
    named = haplotypes.classes(x.copies, member, "hybrid")
    return plain(named.groupBy("region_ord", "Hap", "ClusterID").agg(F.count("*").alias("n")))


@query
def q28_state_map(spark, sf_dir):
    return plain(encoding.state_map(Lens(spark, sf_dir).haps).select("region_ord", "at", "token", "state"))


@query
def q29_encoded_sequences(spark, sf_dir):
    x = Lens(spark, sf_dir)
    return plain(encoding.encode(x.haps, encoding.state_map(x.haps)).select("region_ord", "hap", "code"))


@query
def q30_sample_copy_fasta(spark, sf_dir):
    x = Lens(spark, sf_dir, "hybrid").written()
    codes = encoding.encode(x.haps, encoding.state_map(x.haps))
    named = x.copies.join(codes.select("region_ord", "hap", "code"), ["region_ord", "hap"])
    return plain(named.select("region_ord", F.concat(F.lit(">"), "sample", F.lit("|copy"), (F.col("copy") + 1).cast("string"), F.lit("|"), "hap").alias("name"), "code"))


@query
def q31_nexus_phylip(spark, sf_dir):
    x = Lens(spark, sf_dir)
    states = encoding.state_map(x.haps)
    size = x.haps.groupBy("region_ord").agg(F.count("*").alias("ntax"), F.max(F.size("seq")).alias("nchar"))
    return plain(size.join(encoding.symbols(states), "region_ord"))


@query
def q32_class_min_count(spark, sf_dir):
    return plain(traits.class_counts(Lens(spark, sf_dir).named(), "Hap", ["region_ord"], MIN_COUNT))


@query
def q33_group_class_crosstab(spark, sf_dir):
    return plain(Lens(spark, sf_dir).crosstab().select("region_ord", "Type", "ClusterID", "n"))


@query
def q34_group_proportions(spark, sf_dir):
    return plain(Lens(spark, sf_dir).crosstab().select("region_ord", "Type", "ClusterID", "share"))


@query
def q35_pie_labels(spark, sf_dir):
    return plain(traits.pie_slices(Lens(spark, sf_dir).crosstab(), "Type", ["region_ord"]).select("region_ord", "Type", "ClusterID", "n", (F.col("label") != "").cast("int").alias("labelled")))


@query
def q36_kruskal(spark, sf_dir):
    return plain(traits.kruskal(Lens(spark, sf_dir).values(), ["region_ord"]).select("region_ord", "trait", "n", "k", "h", "pvalue"))


@query
def q37_mannwhitney(spark, sf_dir):
    return plain(traits.pairwise(Lens(spark, sf_dir).values(), ["region_ord"]).select("region_ord", "trait", "class1", "class2", "n1", "n2", "mean1", "mean2", "u", "z", "pvalue", "padj"))


@query
def q38_trait_significance(spark, sf_dir):
    table = traits.report(Lens(spark, sf_dir).values(), ["region_ord"], "cluster")
    return plain(table.drop("trait_ord", "ord1", "ord2"))


@query
def q39_boxplot_stats(spark, sf_dir):
    return plain(traits.box_stats(Lens(spark, sf_dir).values(), ["region_ord"]))


@query
def q40_top_annotations(spark, sf_dir):
    table = traits.report(Lens(spark, sf_dir).values(), ["region_ord"], "cluster")
    return plain(traits.top_annotations(table, ["region_ord"]).select("region_ord", "trait", "Class1", "Class2", "padj_BH", "place"))


def _annotation(spark, sf_dir):
    """Gene features over the lens: one gene, some exons and CDS a supplier."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet")), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.join(F.broadcast(spark.read.parquet(f"{sf_dir}/region.parquet")), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    kinds = F.array(*map(F.lit, ("gene", "exon", "CDS", "five_prime_utr", "intron")))
    rows = s.select("r_name", key.alias("key"), F.posexplode(kinds).alias("i", "kind")).where("kind <> 'gene' or key % 2 = 0")
    start = 100 + F.col("key") * 13 % 1100 + F.col("i") * 20
    width = F.when(F.col("kind") == "gene", 200).otherwise(30 + F.col("key") % 40)
    attrs = F.when(F.col("key") % 3 == 0, F.concat(F.lit("ID=g"), F.col("key").cast("string"), F.lit(";Name=G"), F.col("key").cast("string"))).when(
        F.col("key") % 3 == 1, F.concat(F.lit('gene_id "x"; gene_name "N'), F.col("key").cast("string"), F.lit('"'))
    ).otherwise("note")
    lines = rows.select(
        (F.col("key") * 10 + F.col("i")).alias("ord"),
        F.concat_ws("\t", "r_name", F.lit("src"), "kind", start.cast("string"), (start + width).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs).alias("line"),
    )
    window = lens.regions(spark, sf_dir).withColumn("start", F.lit(300).cast("long")).withColumn("stop", F.lit(900).cast("long"))
    return readers.features_in(readers.parse_annotation(lines), window)


@query
def q41_gff_overlap(spark, sf_dir):
    return plain(_annotation(spark, sf_dir).select("seqid", "ftype", "start", "stop", "feature_ord"))


@query
def q42_gene_children(spark, sf_dir):
    f = _annotation(spark, sf_dir)
    return plain(plotdata.blocks(f, plotdata.genes(f)).groupBy("region_ord", "ftype").agg(F.count("*").alias("n")))


@query
def q43_clip_blocks(spark, sf_dir):
    f = _annotation(spark, sf_dir)
    out = plotdata.blocks(f, plotdata.genes(f)).select("region_ord", "ftype", "start", "stop", "left", "right", "width", "height", "priority").distinct()
    return plain(out)


@query
def q44_attrs_name(spark, sf_dir):
    f = _annotation(spark, sf_dir)
    return plain(f.select("feature_ord", text.feature_name(F.col("attrs"), F.col("ftype")).alias("name")))


@query
def q45_token_matrix(spark, sf_dir):
    x = Lens(spark, sf_dir)
    member = x.clustered()
    return plain(plotdata.token_matrix(clustering.consensus_tokens(x.haps, member, x.sites), "cluster"))


@query
def q46_variant_connectors(spark, sf_dir):
    return plain(plotdata.connectors(lens.sites(spark, sf_dir)))


@query
def q47_priority_carriers(spark, sf_dir):
    """Fisher test of urgent orders between segments, by order status."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    sample = F.col("o_custkey").cast("string")
    calls = orders.select(F.lit(0).alias("region_ord"), F.ascii("o_orderstatus").cast("long").alias("site_ord"), sample.alias("sample"), F.array(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("gt"))
    merged = calls.groupBy("region_ord", "site_ord", "sample").agg(F.array(F.max(F.col("gt")[0])).alias("gt"))
    groups = customers.select(F.col("c_custkey").cast("string").alias("sample"), F.col("c_mktsegment").alias("grp"))
    counts = association.carrier_counts(merged, groups, G1, G2)
    from locusframe.functions.statistics import fisher_exact

    return plain(counts.withColumn("pvalue", fisher_exact(*map(F.col, "abcd"))))


@query
def q48_price_by_flag(spark, sf_dir):
    """Kruskal-Wallis of line prices by return flag."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit(0).alias("region_ord"), "l_returnflag", "l_extendedprice", "l_quantity")
    values = traits.long_traits(lines, "l_returnflag", ["l_extendedprice", "l_quantity"], ["region_ord"])
    return plain(traits.kruskal(values, ["region_ord"]).select("trait", "n", "k", "h", "pvalue"))


@query
def q49_brand_type_crosstab(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit(0).alias("region_ord"), "p_brand", "p_type")
    return plain(traits.crosstab(parts, "p_brand", "p_type", ["region_ord"], 2).select("p_type", "p_brand", "n", "share"))
