"""Operators against hand-made cases, published numbers and plain Python."""

import gzip
import itertools
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import demo
from locusframe.functions import alleles, ranges, statistics, text
from locusframe.operators import association, clustering, encoding, haplotypes, intervals, plotdata, traits
from locusframe.plans import oracle, queries
from locusframe.plans.engine import EmptyRegion, Engine, Options
from locusframe.sources import lens, readers


def one(spark, **cols):
    r = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).collect()[0]
    return r[0] if len(cols) == 1 else r


@pytest.mark.parametrize(
    "ref,alts,info,tokens",
    [
        ("A", "G,T", ".", "A,G,T"), ("A", "ATG,ATTG", ".", "A,+2,+3"), ("ACGT", "A", ".", "REF4,-3"), ("G", "A,<PAV>,T", "SVTYPE=PAV", "G,A,PAV,T"),
        ("A", "<DEL>", "SVLEN=-40,5", "A,-40"), ("A", "<INS:ME>", ".", "A,INS"), ("A", "<DEL>", "SVLEN=0", "A,DEL"), ("a", "*,.", ".", "A,N,N"),
        ("A" * 21, "C" * 21, ".", "REF21,SEQ21"), ("AC", "gt", ".", "AC,GT"), ("AR", "AG", ".", "REF2,AG"), (".", "G", ".", "N,G"), ("AC", "<X>", ".", "REF2,X"),
    ],
)
def test_tokens(spark, ref, alts, info, tokens):
    sv = alleles.info_int(alleles.parse_info(F.lit(info)), "SVLEN")
    assert one(spark, t=alleles.encode_alleles(F.lit(ref), F.split(F.lit(alts), ","), sv)) == tokens.split(",")


def test_info(spark):
    got = one(spark, m=alleles.parse_info(F.lit("A=1;B;;A=2=3;C=")))
    assert got == {"A": "2=3", "B": "True", "C": ""}
    assert one(spark, m=alleles.parse_info(F.lit("."))) == {}


@pytest.mark.parametrize("fmt,cell,gt", [("GT", "0|1", [0, 1]), ("DP:GT", "9:1/.", [1, None]), ("DP", "9", [None]), ("GT", ".", [None]), ("GT", "x|2", [None, 2]), ("GT:DP", "1", [1])])
def test_genotypes(spark, fmt, cell, gt):
    assert one(spark, g=alleles.decode_genotype(F.lit(fmt), F.lit(cell))) == gt


@pytest.mark.parametrize(
    "tokens,policy,want",
    [
        (["A", "G"], "slash", "A/G"), (["G", "A"], "slash", "G/A"), (["N", "A"], "slash", "A"), (["N", "N"], "slash", "N"), ([], "slash", "N"), (["A", "G"], "iupac", "R"),
        (["G", "A"], "iupac", "R"), (["A", "C", "G", "T"], "iupac", "N"), (["A", "+2"], "iupac", "A/+2"), (["A", "G"], "missing", "N"), (["A", "A"], "missing", "A"),
    ],
)
def test_consensus(spark, tokens, policy, want):
    t = F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>")
    assert one(spark, c=alleles.consensus(t, policy)) == want


def test_token_outside_the_alleles(spark):
    t = F.array(F.lit("A"), F.lit("G"))
    assert one(spark, x=alleles.genotype_tokens(t, F.array(F.lit(9), F.lit(-1), F.lit(None).cast("int"), F.lit(1)))) == ["N", "N", "N", "G"]


def fisher_python(a, b, c, d):
    r1, r2, k = a + b, c + d, a + c
    if r1 + r2 == 0:
        return 1.0
    p = {x: math.comb(r1, x) * math.comb(r2, k - x) / math.comb(r1 + r2, k) for x in range(max(0, k - r2), min(r1, k) + 1)}
    return min(1.0, sum(v for v in p.values() if v <= p[a] + 1e-12))


def test_fisher(spark):
    tables = [(12, 28, 40, 0), (0, 40, 23, 17), (12, 28, 21, 19), (8, 32, 40, 0), (11, 29, 20, 20), (0, 0, 0, 0), (3, 0, 0, 0), (1, 1, 1, 1), (0, 5, 5, 0), (7, 3, 2, 900)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    for r in df.withColumn("p", statistics.fisher_exact(*map(F.col, "abcd"))).collect():
        assert r["p"] == pytest.approx(fisher_python(*r[:4]), rel=1e-9)
    got = {tuple(r[:4]): r["p"] for r in df.withColumn("p", statistics.fisher_exact(*map(F.col, "abcd"))).collect()}
    assert got[(12, 28, 40, 0)] == pytest.approx(3.839359e-12, rel=1e-6)
    assert got[(0, 40, 23, 17)] == pytest.approx(2.597900e-09, rel=1e-6)
    assert got[(8, 32, 40, 0)] == pytest.approx(1.00542e-12, rel=1e-5)


def test_published_site_tests(spark):
    """Counts of eight sites in the published demo, with their tests and adjusted values."""
    counts = [(12, 28, 40, 0)] + [(0, 40, 23, 17)] * 5 + [(12, 28, 21, 19), (12, 28, 40, 0)]
    df = spark.createDataFrame([(0, i, *c) for i, c in enumerate(counts)], "g int, i int, a long, b long, c long, d long").withColumn("p", statistics.fisher_exact(*map(F.col, "abcd")))
    got = statistics.benjamini_hochberg(df, "p", "q", ["g"]).orderBy("i").collect()
    assert [r["p"] for r in got] == [pytest.approx(v, rel=1e-5) for v in [3.839359e-12] + [2.597900e-09] * 5 + [0.0685011, 3.839359e-12]]
    assert [r["q"] for r in got] == [pytest.approx(v, rel=1e-5) for v in [1.53574e-11] + [2.96903e-09] * 5 + [0.0685011, 1.53574e-11]]
    more = spark.createDataFrame([(8, 32, 17, 23), (11, 29, 40, 0), (11, 29, 20, 20)], "a long, b long, c long, d long")
    assert [r[0] for r in more.select(statistics.fisher_exact(*map(F.col, "abcd"))).collect()] == [pytest.approx(v, rel=1e-5) for v in (0.0525327, 8.86006e-13, 0.065572)]


def test_adjustment_is_monotone_and_skips_nulls(spark):
    rows = [(0, p) for p in (0.01, 0.04, 0.03, 0.5, 0.01, None)]
    got = statistics.benjamini_hochberg(spark.createDataFrame(rows, "g int, p double"), "p", "q", ["g"]).collect()
    want = {0.01: 0.025, 0.04: 0.05, 0.03: 0.05, 0.5: 0.5, None: None}
    for r in got:
        assert r["q"] == (None if want[r["p"]] is None else pytest.approx(want[r["p"]]))


def test_chi_square_and_normal_tails(spark):
    df = spark.createDataFrame([(95.55120197911630, 2), (3.841458820694124, 1), (7.814727903251179, 3), (9.487729036781154, 4), (0.0, 3)], "h double, k int")
    got = [r[0] for r in df.select(statistics.chi_square_tail(F.col("h"), F.col("k"))).collect()]
    assert got[0] == pytest.approx(1.7836930520288015e-21, rel=1e-9)
    assert got[1:4] == [pytest.approx(0.05, rel=1e-9)] * 3 and got[4] == 1.0


def test_rank_sum_by_hand(spark):
    """Two classes of ten values with ties: tie-corrected z and its p-value."""
    rng_values = [("x", float(v)) for v in [1, 2, 2, 3, 5, 8, 8, 9, 9, 9]] + [("y", float(v)) for v in [4, 6, 6, 7, 8, 10, 11, 12, 12, 13]]
    df = spark.createDataFrame([(0, c, v) for c, v in rng_values], "region_ord int, cls string, v double")
    values = traits.long_traits(df, "cls", ["v"], ["region_ord"])
    got = traits.pairwise(values, ["region_ord"]).collect()[0]
    xs, ys = [v for c, v in rng_values if c == "x"], [v for c, v in rng_values if c == "y"]
    u = sum((x > y) + 0.5 * (x == y) for x in xs for y in ys)
    big = max(u, len(xs) * len(ys) - u)
    ties = sum(t**3 - t for t in Counter(xs + ys).values())
    n1, n2 = len(xs), len(ys)
    n = n1 + n2
    z = (big - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    assert got["u"] == big and got["z"] == pytest.approx(z) and got["pvalue"] == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_exact_rank_sum(spark):
    xs, ys = [1.0, 4.0, 6.0], [2.0, 3.0, 5.0, 7.0, 8.0]
    df = spark.createDataFrame([(0, "x", v) for v in xs] + [(0, "y", v) for v in ys], "region_ord int, cls string, v double")
    got = traits.pairwise(traits.long_traits(df, "cls", ["v"], ["region_ord"]), ["region_ord"]).collect()[0]
    both = sorted(xs + ys)
    us = [sum(a > b for a in s for b in both if b not in s) for s in itertools.combinations(both, len(xs))]
    u = sum(a > b for a in xs for b in ys)
    big = max(u, 15 - u)
    assert got["pvalue"] == pytest.approx(min(1.0, 2 * sum(x >= big for x in us) / len(us)))


def test_exact_rank_sum_of_many(spark):
    df = spark.createDataFrame([(8, 3000, 16000.0), (3, 4, 12.0), (1, 1, 1.0), (2, 3, 3.0)], "a long, b long, u double")
    got = [r[0] for r in df.select(statistics.exact_rank_sum_p(F.col("a"), F.col("b"), F.col("u"))).collect()]
    z = (16000 - 12000 - 0.5) / math.sqrt(8 * 3000 * 3009 / 12)
    assert got[0] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=0.02)
    assert got[1:] == [pytest.approx(2 / 35), 1.0, 1.0]


def test_average_ranks_over_parts(spark):
    rows = [(g, float(i * 7 % 40)) for g in (0, 1) for i in range(150 + g)]
    df = spark.createDataFrame(rows, "g int, value double").repartition(7)
    got = {(r["g"], r["value"]): (r["t"], r["r"]) for r in traits.average_ranks(df, ["g"]).collect()}
    for g in (0, 1):
        vs = sorted(v for k, v in rows if k == g)
        for v in set(vs):
            assert got[(g, v)] == (vs.count(v), vs.index(v) + (vs.count(v) + 1) / 2)


def test_symbols_lists_stems_and_colours(spark):
    ps = spark.createDataFrame([(None,), (float("nan"),), (0.001,), (0.01,), (0.05,), (0.0501,)], "p double")
    assert [r[0] for r in ps.select(text.significance(F.col("p"))).collect()] == ["NA", "NA", "***", "**", "*", "ns"]
    assert text.csv_list(" a, ,b,") == ["a", "b"] and text.csv_list(" , ") is None and text.csv_list(None) is None
    assert text.level_column("hap") == "Hap" and text.level_column("cluster") == "ClusterID"
    with pytest.raises(ValueError, match="hap or cluster"):
        text.level_column("gene")
    assert [text.level_stem(level, stem) for level in ("hap", "cluster") for stem in ("Groups", "GeneHaplotype")] == [".Groups", ".GeneHaplotype", ".ClusterGroups", ".GeneClusterHaplotype"]
    assert text.file_label("chr 1/x:1-2_3.b") == "chr_1_x_1-2_3.b"
    got = [r[0] for r in spark.range(25).select(plotdata.colours(F.col("id"))).collect()]
    assert got[:12] == list(plotdata.PALETTE) and got[12:24] == got[:12] and got[24] == got[0]


def test_jitter_stays_near_its_class(spark):
    values = spark.createDataFrame([(0, "v", 1, float(i)) for i in range(200)] + [(0, "v", 2, None)], "region_ord int, trait string, ord int, value double")
    got = traits.jitter_points(values).collect()
    assert len(got) == 200 and all(abs(r["x"] - 1) < 0.3 for r in got) and len({r["x"] for r in got}) == 200


def test_adjustment_switch(spark):
    sites = spark.createDataFrame([(0, k, "c", k, f"v{k}") for k in (1, 2)], "region_ord int, site_ord long, chrom string, pos long, vid string")
    calls = spark.createDataFrame([(0, k, f"s{i}", [int(i < 4 + 2 * k)]) for k in (1, 2) for i in range(12)], "region_ord int, site_ord long, sample string, gt array<int>")
    groups = spark.createDataFrame([(f"s{i}", "a" if i < 6 else "b") for i in range(12)], "sample string, grp string")
    raw, adjusted = ({r["site_ord"]: (r["pvalue"], r["padj"]) for r in association.fisher_table(sites, calls, groups, "a", "b", 0.05, how).collect()} for how in ("none", "FDR"))
    assert all(p == q for p, q in raw.values())
    ps = sorted(p for p, _ in raw.values())
    assert sorted(q for _, q in adjusted.values()) == [pytest.approx(min(2 * ps[0], ps[1])), pytest.approx(ps[1])]


def test_trait_edge_cases(spark):
    rows = [(0, "x", 5.0, None), (0, "x", 5.0, None), (0, "y", 5.0, 1.0), (0, "y", 5.0, 2.0)]
    values = traits.long_traits(spark.createDataFrame(rows, "region_ord int, cls string, same double, half double"), "cls", ["same", "half"], ["region_ord"])
    k = {r["trait"]: r for r in traits.kruskal(values, ["region_ord"]).collect()}
    assert "failed" in k["same"]["skipped"] and k["same"]["pvalue"] is None
    assert "fewer" in k["half"]["skipped"] and k["half"]["n"] == 2
    p = {r["trait"]: r for r in traits.pairwise(values, ["region_ord"]).collect()}
    assert p["same"]["pvalue"] == 1.0 and p["half"]["skipped"] and p["half"]["padj"] is None


def _haps(spark, seqs):
    rows = [(0, [*s], i + 1, f"Hap{i + 1:03d}") for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "region_ord int, seq array<string>, hap_rank int, hap string")


@pytest.mark.parametrize("threshold,want", [(-1.0, 5), (0.0, 4), (0.34, 3), (1.0, 1)])
def test_cluster_counts(spark, threshold, want):
    haps = _haps(spark, ["AAA", "AAC", "TTT", "NNN", "ANA"])
    got = clustering.clusters(haps, threshold).collect()
    assert len({r["cluster"] for r in got}) == want and len(got) == 5


def test_state_map_takes_free_characters(spark):
    haps = _haps(spark, [["A/G"], ["A"], ["C"], ["G"], ["T"]])
    assert {r["token"]: r["state"] for r in encoding.state_map(haps).collect()} == {"A": "A", "C": "C", "G": "G", "T": "T", "A/G": "N"}
    with pytest.raises(Exception, match="more token states"):
        encoding.state_map(_haps(spark, [[f"x{i}"] for i in range(63)])).collect()


def test_ids_past_999_and_natural_order(spark):
    assert one(spark, h=text.hap_id(F.lit(1000))) == "Hap1000"
    df = spark.createDataFrame([("+10",), ("+2",), ("A",)], "t string").orderBy(text.natural_key(F.col("t")))
    assert [r[0] for r in df.collect()] == ["+2", "+10", "A"]


def test_gene_model_without_gene(spark):
    lines = spark.createDataFrame([(0, "c\ts\texon\t100\t200\t.\t+\t.\tID=e"), (1, "c\ts\tCDS\t150\t400\t.\t+\t.\tnote"), (2, "short\tline")], "ord long, line string")
    regions = spark.createDataFrame([(0, "c", 120, 300)], readers.REGION_SCHEMA)
    near = readers.features_in(readers.parse_annotation(lines), regions)
    genes = plotdata.genes(near)
    g = genes.collect()[0]
    assert (g["name"], g["start"], g["stop"], g["line_from"], g["line_to"]) == ("gene_model", 100, 400, 120, 300)
    got = {r["ftype"]: (r["left"], r["right"], r["width"]) for r in plotdata.blocks(near, genes).collect()}
    assert got == {"exon": (120, 200, 81), "CDS": (150, 300, 151)}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("demo")
    for p in (1, 2, 3):
        (d / f"p{p}.vcf").write_text(demo.vcf(p))
    with gzip.open(d / "p2.vcf.gz", "wt") as f:
        f.write(demo.vcf(2))
    (d / "groups.tsv").write_text("# comment\n" + demo.groups() + "C001\tCultivar\n")
    (d / "traits.tsv").write_text(demo.traits())
    (d / "demo.gff3").write_text(demo.GFF)
    (d / "regions.tsv").write_text("ChrDemo\t900\t2900\nChrDemo\t1200\t2000\n")
    return d


def plain_haps(ploidy, mode, sites):
    members = {}
    for i, a in enumerate(demo.ACCESSIONS):
        fs = demo.founders_of(i, ploidy)
        tokens = [[["A", "G", "T", "C"], ["C", "G", "T"], ["A", "+2", "+3"], ["T", "C", "A", "G"], ["A", "T", "G"], ["G", "A", "PAV", "T"], ["C", "T", "G"], ["A", "C", "G"]][k][demo.FOUNDERS[f][k]] for f in fs for k in sites]
        rows = [tuple(tokens[j * len(sites) : (j + 1) * len(sites)]) for j in range(len(fs))]
        if mode == "inbred":
            rows = [tuple("/".join(dict.fromkeys(r[k] for r in rows)) for k in range(len(sites)))]
        for r in rows:
            members.setdefault(r, set()).add(a)
    return sorted(((r, len(s)) for r, s in members.items()), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("ploidy,mode", [(1, "inbred"), (2, "inbred"), (2, "hybrid"), (3, "hybrid")])
def test_analysis_end_to_end(spark, files, tmp_path, ploidy, mode):
    o = Options(mode=mode, fisher_groups=("Cultivar", "Landrace"), fisher_alpha=0.05, cluster_threshold=0.2)
    name = f"p{ploidy}.vcf" + (".gz" if ploidy == 2 and mode == "hybrid" else "")
    r = Engine(spark).analyze(str(files / name), str(files / "groups.tsv"), str(tmp_path), "ChrDemo:900-2900", trait_file=str(files / "traits.tsv"), gff_file=str(files / "demo.gff3"), options=o, plots=ploidy == 2)
    kept = [x["site_ord"] for x in r.fisher.where("keep").orderBy("site_ord").collect()]
    order = [x["site_ord"] for x in r.fisher.orderBy("site_ord").collect()]
    sites = [order.index(k) for k in kept]
    carriers = lambda k, lo, hi: sum(any(demo.FOUNDERS[f][k] > 0 for f in demo.founders_of(i, ploidy)) for i in range(lo, hi))
    assert sites == [k for k in range(8) if fisher_python(carriers(k, 0, 60), 60 - carriers(k, 0, 60), carriers(k, 60, 120), 60 - carriers(k, 60, 120)) <= 0.05]
    got = [(tuple(x["seq"]), x["n"]) for x in r.haps.orderBy("hap_rank").collect()]
    assert got == plain_haps(ploidy, mode, sites)
    lines = open(r.paths[0]["summary"]).read().splitlines()
    assert lines[1].startswith("CHR\t") and len(lines) == 3 + len(got)
    assert len(open(r.paths[0]["group"]).read().splitlines()) == 121
    genotypes = open(r.paths[0]["genotypes"]).read().splitlines()
    assert genotypes[0].split("\t")[3:] == demo.ACCESSIONS and len(genotypes) == 1 + len(sites)
    fa = open(r.paths[0]["sample_fasta"]).read().splitlines()
    assert len(fa) == 2 * 120 * (1 if mode == "inbred" else ploidy)
    shares = r.hap_group.groupBy("Type").count().collect()
    assert sum(x["count"] for x in shares) == 120


SMALL = """##fileformat=VCFv4.2
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	s1	s2	x	s3
01	100	v1	A	G	.	PASS	.	GT	0|0	1|1	0|0	0|1
1	150	v0	A	G	.	PASS	.	GT	0|0	1|1	0|0	0|1
01	200	.	AC	A,<DEL>	.	PASS	SVTYPE=DEL;SVLEN=-40	GT:DP	0|1:3	.|1:2	0|0:1	2|2:9
01	300	v3	T	TG	.	q10	.	GT	0/0	1|1	0|0	1|1
01	301	v4	T	G	.	PASS	.	GT	0/0	1|1	0|0	1|1
"""
# what each file holds, worked out by hand
FILES = {
    "ProcessedVariants.tsv": "CHROM POS ID REF ALT AlleleTokens\n01 100 v1 A G A,G\n01 200 01:200 AC A,<DEL> REF2,-1,-40\n01 300 v3 T TG T,+1\n",
    "SampleGenotypeTokens.tsv": "CHROM POS ID s1 s2 s3\n01 100 v1 A/A G/G A/G\n01 200 01:200 REF2/-1 N/-1 -40/-40\n01 300 v3 T/T +1/+1 +1/+1\n",
    "HapSummary.tsv": "Hap ClusterID 100 200 300 Accession Number\nCHR _ 01 01 01 _ NA\nPOS _ 100 200 300 _ NA\nHap001 HapC1 A REF2/-1 T s1 1\nHap002 HapC2 A/G -40 +1 s3 1\nHap003 HapC2 G -1 +1 s2 1\n",
    "HapGroup.tsv": "Hap ClusterID Accession Type Height_(cm)\nHap001 HapC1 s1 A 1.5\nHap003 HapC2 s2 A _\nHap002 HapC2 s3 B _\n",
    "Haplotype.fa": ">Hap001\nAGT\n>Hap002\nCCA\n>Hap003\nGAA\n",
    "Haplotype.phy": "3~3\nHap001~AGT\nHap002~CCA\nHap003~GAA\n",
    "Haplotype.nex": '#NEXUS\n\nBEGIN~DATA;\n~~DIMENSIONS~NTAX=3~NCHAR=3;\n~~FORMAT~DATATYPE=STANDARD~SYMBOLS="ACGT"~MISSING=N~GAP=-;\n~~MATRIX\n~~Hap001~AGT\n~~Hap002~CCA\n~~Hap003~GAA\n~~;\nEND;\n',
    "AlleleStateMap.tsv": "CHROM POS OriginalToken EncodedState\n01 100 A A\n01 100 A/G C\n01 100 G G\n01 200 -1 A\n01 200 -40 C\n01 200 REF2/-1 G\n01 300 +1 A\n01 300 T T\n",
    "Haplotype_sample.fa": ">s1|Hap001\nAGT\n>s2|Hap003\nGAA\n>s3|Hap002\nCCA\n",
}


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    d = tmp_path_factory.mktemp("small")
    (d / "v.vcf").write_text(SMALL)
    (d / "g.tsv").write_text("s3\tB\ns1\tB\textra\n\n# note\ns2\tA\ns1\tA\ngone\tB\n")
    (d / "t.tsv").write_text("name\tHeight (cm)\ns1\t1.5\ns2\t\n")
    return d


@pytest.mark.parametrize("backend", ["cyvcf2", "parquet"])
def test_bytes_of_the_files(spark, small, tmp_path, backend):
    source = small / "v.vcf"
    if backend == "parquet":
        source = tmp_path / "records"
        readers.ingest(spark, str(small / "v.vcf"), str(source))
    o = Options(fisher_groups=("A", "B"), fisher_alpha=1.0, cluster_threshold=0.7, vcf_backend=backend)
    if backend == "parquet":
        regions = readers.read_regions(spark, "01:100-300")
        got = readers.sites_of(readers.in_regions(readers.read_variants(spark, str(source), backend), regions)).orderBy("pos").collect()
        # the name of a chromosome stays as it is written
        assert [(r["chrom"], r["pos"], r["vid"]) for r in got] == [("01", 100, "v1"), ("01", 200, "01:200"), ("01", 300, "v3")]
        return
    r = Engine(spark).analyze(str(source), str(small / "g.tsv"), str(tmp_path / "out"), "01:100-300", trait_file=str(small / "t.tsv"), options=o)
    for name, want in FILES.items():
        lines = want.split("\n")
        if name.endswith(".tsv"):
            lines = ["\t".join("" if v == "_" else v.replace("_(", " (") for v in line.split(" ")) for line in lines]
        with open(tmp_path / "out" / f"01_100_300.{name}", encoding="utf-8") as f:
            assert f.read() == "\n".join(lines).replace("~", " "), name
    table = [line.split("\t") for line in open(r.paths[0]["fisher"]).read().splitlines()]
    assert table[0] == ["CHROM", "POS", "ID", "A_ALT", "A_REF", "B_ALT", "B_REF", "pvalue", "padj", "keep"]
    assert [row[:7] for row in table[1:]] == [["01", "100", "v1", "1", "1", "1", "0"], ["01", "200", "01:200", "2", "0", "1", "0"], ["01", "300", "v3", "1", "1", "1", "0"]]
    assert all(float(row[7]) == pytest.approx(1.0) and row[9] == "True" for row in table[1:])


def test_hybrid_sample_names(spark, small, tmp_path):
    r = Engine(spark).analyze(str(small / "v.vcf"), str(small / "g.tsv"), str(tmp_path), "01:100-300", options=Options(mode="hybrid", cluster_threshold=0.0))
    names = open(r.paths[0]["sample_fasta"]).read().splitlines()[::2]
    assert [n.split("|")[:2] for n in names] == [[f">{s}", f"copy{c}"] for s in ("s1", "s2", "s3") for c in (1, 2)]


def test_regions_prune_the_scan(spark, small, tmp_path):
    readers.ingest(spark, str(small / "v.vcf"), str(tmp_path / "v"))
    regions = readers.read_regions(spark, "1:100-200")
    found = readers.in_regions(readers.read_variants(spark, str(tmp_path / "v"), "parquet"), regions)
    assert [(r["chrom"], r["pos"]) for r in found.collect()] == [("1", 150)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "= 1)" in plan and "GreaterThanOrEqual(pos,100)" in plan and "LessThanOrEqual(pos,200)" in plan


def test_many_regions_still_prune(spark, monkeypatch):
    monkeypatch.setattr(readers, "MOST_LITERALS", 2)
    records = spark.createDataFrame([("a", 5), ("a", 50), ("b", 7), ("c", 9)], "chrom string, pos long")
    for chroms, want in ((["a", "a", "b"], [("a", 5), ("a", 50), ("b", 7)]), (["a", "b", "c"], [("a", 5), ("b", 7), ("c", 9)])):
        rows = [(i, c, 1 + 40 * (chroms[:i].count(c)), 10 + 45 * (chroms[:i].count(c))) for i, c in enumerate(chroms)]
        got = readers.in_regions(records, spark.createDataFrame(rows, readers.REGION_SCHEMA)).select("chrom", "pos").collect()
        assert sorted(map(tuple, got)) == want
    assert readers.in_regions(records, spark.createDataFrame([], readers.REGION_SCHEMA)).count() == 0


def test_command_line(spark, small, tmp_path, capsys):
    from locusframe.cli import main, parser

    a = parser().parse_args(["analyze", "--vcf", "v", "--group", "g", "--traits", "t", "--gff", "x", "--outdir", "o", "--vcf-backend", "pysam", "--plot-format", "png,svg"])
    assert (a.group_file, a.trait_file, a.gff_file, a.mode, a.hetero_policy, a.fisher_adjust, a.cluster_threshold, a.plot_hap_level, a.plot_min_count) == ("g", "t", "x", "inbred", "slash", "none", 0.15, "hap", 1)
    with pytest.raises(SystemExit) as end:
        main(["--version"])
    assert end.value.code == 0
    gff = small / "a.gff3"
    gff.write_text("01\ts\tgene\t90\t310\t.\t+\t.\tID=g;Name=G1\n01\ts\texon\t120\t200\t.\t+\t.\tID=e\n")
    where = ["--vcf", str(small / "v.vcf"), "--region", "01:100-300"]
    assert main(["prepare", *where, "--outdir", str(tmp_path / "p")]) == 0
    assert open(tmp_path / "p" / "01_100_300.ProcessedVariants.tsv").read().count("\n") == 4
    assert main(["ingest", "--vcf", str(small / "v.vcf"), "--out", str(tmp_path / "records")]) == 0
    more = ["--group", str(small / "g.tsv"), "--traits", str(small / "t.tsv"), "--gff", str(gff), "--plot", "--plot-hap-level", "cluster", "--cluster-threshold", "0.7", "--no-processed", "--trait-cols", "Height (cm),none"]
    assert main(["analyze", *where, *more, "--outdir", str(tmp_path / "a")]) == 0
    said = capsys.readouterr()
    assert "01_100_300.HapSummary.tsv" in said.out and "data tables" in said.err
    names = {p.name.removeprefix("01_100_300.") for p in (tmp_path / "a").iterdir()}
    assert {"ClusterTraitSignificance.tsv", "GeneClusterHaplotype_blocks.tsv", "Clusterplot_matrix.tsv", "Clusterplot_points.tsv"} <= names and "ProcessedVariants.tsv" not in names
    shown = open(tmp_path / "a" / "01_100_300.Clusterplot_matrix.tsv").read().splitlines()
    assert shown[0].split("\t")[-1] == "colour" and len(shown) == 1 + 2 * 3


def test_min_count_hides_rows_of_the_matrix(spark, files, tmp_path):
    e = Engine(spark)
    r = e.analyze(str(files / "p1.vcf"), str(files / "groups.tsv"), str(tmp_path), "ChrDemo:900-2900", options=Options(min_count=20, write_processed=False))
    sizes = {h["hap"]: h["n"] for h in r.haps.collect()}
    assert {x["hap"] for x in e.plot_data(r)["matrix"].collect()} == {h for h, n in sizes.items() if n >= 20} != set(sizes)


def test_groups_without_alpha_filter_nothing(spark, small, tmp_path):
    with pytest.warns(UserWarning, match="not filtered"):
        r = Engine(spark).analyze(str(small / "v.vcf"), str(small / "g.tsv"), str(tmp_path), "01:100-301", options=Options(fisher_groups=("A", "B")))
    assert r.fisher is None and r.sites.count() == 4


def test_prepare_and_errors(spark, files, tmp_path):
    e = Engine(spark)
    out = e.prepare(str(files / "p1.vcf"), str(tmp_path), "ChrDemo:1-50", str(files / "regions.tsv"))
    assert len(out) == 2 and len(open(out[0][0]).read().splitlines()) == 9
    with pytest.raises(EmptyRegion):
        e.analyze(str(files / "p1.vcf"), str(files / "groups.tsv"), str(tmp_path), "ChrDemo:1-50")
    for spec in ("ChrDemo:9-1", "ChrDemo:1,000-2,000", "ChrDemo", "a:b:1-2", "c:0-5"):
        with pytest.raises(readers.InputError):
            readers.parse_region(spec)
    for path, backend in (("x.bcf", "auto"), ("x.vcf", "tabix")):
        with pytest.raises(readers.InputError):
            readers.variant_format(path, backend)
    bad = files / "bad.tsv"
    bad.write_text("C001 Cultivar\n")
    with pytest.raises(readers.InputError):
        readers.read_groups(spark, str(bad))


def test_ingest_matches_text(spark, files, tmp_path):
    readers.ingest(spark, str(files / "p2.vcf"), str(tmp_path / "v"))
    regions = readers.read_regions(spark, "ChrDemo:1200-2000")
    a = readers.sites_of(readers.in_regions(readers.read_variants(spark, str(files / "p2.vcf")), regions)).select("pos", "tokens").orderBy("pos").collect()
    b = readers.sites_of(readers.in_regions(readers.read_variants(spark, str(tmp_path / "v"), "parquet"), regions)).select("pos", "tokens").orderBy("pos").collect()
    assert a == b and len(a) == 4


def test_stream(spark, files, tmp_path):
    import shutil

    from locusframe.streaming.prepare import stream_sites

    shutil.copy(files / "p1.vcf", tmp_path / "a.vcf")
    regions = readers.read_regions(spark, "ChrDemo:900-2900")
    q = stream_sites(spark, str(tmp_path), regions).writeStream.format("memory").queryName("sites_seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("sites_seen").count() == 8


def test_command_line_refuses_three_groups():
    from locusframe.cli import main

    with pytest.raises(SystemExit):
        main(["analyze", "--vcf", "x", "--outdir", "y", "--group-file", "g", "--fisher-groups", "a,b,c"])


def test_hybrid_of_one_copy_equals_inbred(spark):
    sites = spark.createDataFrame([(0, 1, ["A", "G"]), (0, 2, ["C", "T"])], "region_ord int, site_ord long, tokens array<string>")
    pool = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "sample string, sample_ord int")
    calls = spark.createDataFrame([(0, 1, "a", [0]), (0, 2, "a", [1]), (0, 1, "b", [None]), (0, 1, "c", [7])], "region_ord int, site_ord long, sample string, gt array<int>")
    cells = haplotypes.grid(sites, calls, pool)
    got = [sorted((r["sample"], r["seq"]) for r in haplotypes.sequences(cells, m).collect()) for m in ("inbred", "hybrid")]
    assert got[0] == got[1] == [("a", ["A", "T"]), ("b", ["N", "N"]), ("c", ["N", "N"])]


def test_short_lines_and_the_whole_grid(spark):
    lines = spark.createDataFrame([(1, "c\t1\t.\tA\tG\t.\t.\t.\tGT\t0|1\t1"), (2, "c\t2\t.\tC\tT\t.\t.\t.\tGT\t0"), (3, "c\t3\t.\tC\tT\t.\t.\t.")], "ord long, line string")
    header = spark.createDataFrame([(0, "a"), (1, "b")], "sample_ord int, sample string")
    records = readers.in_regions(readers.parse_records(lines), spark.createDataFrame([(0, "c", 1, 9)], readers.REGION_SCHEMA))
    sites, cols = readers.sites_of(records), ["site_ord", "sample", "gt"]
    some = haplotypes.grid(sites, readers.calls_of(records, header), header).select(*cols).collect()
    every = haplotypes.grid(sites, readers.calls_of(records, header, 2), header, complete=True).select(*cols).collect()
    assert sorted(map(str, some)) == sorted(map(str, every)) and len(every) == 6
    assert {(r["site_ord"], r["sample"]): r["gt"] for r in every} == {(1, "a"): [0, 1], (1, "b"): [1], (2, "a"): [0], (2, "b"): None, (3, "a"): None, (3, "b"): None}


def test_same_group_twice(spark):
    calls = spark.createDataFrame([(0, 1, "a", [0, 1]), (0, 1, "b", [0, 0])], "region_ord int, site_ord long, sample string, gt array<int>")
    groups = spark.createDataFrame([("a", "g"), ("b", "g")], "sample string, grp string")
    r = association.carrier_counts(calls, groups, "g", "g").collect()[0]
    assert (r["a"], r["b"], r["c"], r["d"]) == (1, 1, 0, 0)


def _clustered_haps(spark, n, sites, centres, seed, lost=0.15):
    """Haplotypes around a few centres, many of their sites missing."""
    rng = random.Random(seed)
    base = [[rng.choice("ACGT") for _ in range(sites)] for _ in range(centres)]
    seqs = [tuple("N" if rng.random() < lost else rng.choice("ACGT") if rng.random() < 0.03 else t for t in base[i % centres]) for i in range(n)] + [("N",) * sites]
    seqs = list(dict.fromkeys(seqs))
    rows = [(r, list(s), i + 1, f"Hap{i + 1:03d}") for r in (3, 4) for i, s in enumerate(seqs if r == 3 else seqs[:40])]
    return spark.createDataFrame(rows, "region_ord int, seq array<string>, hap_rank int, hap string"), rows


def _distance(a, b):
    both = [(x, y) for x, y in zip(a, b, strict=True) if x != "N" and y != "N"]
    return sum(x != y for x, y in both) / len(both) if both else 1.0


@pytest.mark.parametrize("threshold", [0.0, 0.15, 0.6, 1.0])
def test_links_with_missing_sites(spark, monkeypatch, threshold):
    haps, rows = _clustered_haps(spark, 260, 21, 9, 5)
    want = {(r[0], *sorted((r[3], q[3]))): d for r, q in itertools.combinations(rows, 2) if r[0] == q[0] and (d := _distance(r[1], q[1])) <= threshold}
    up = {(r[0], r[3]): (r[0], r[3]) for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r, one, two in want:
        a, b = root((r, one)), root((r, two))
        up[max(a, b)] = min(a, b)
    for tile in (512, 16):  # whole regions, and pivots with tiles
        monkeypatch.setattr(clustering, "TILE", tile)
        got = clustering.links(haps, threshold).collect()
        assert len(got) == len(want) and {(r["region_ord"], r["hap1"], r["hap2"]): r["distance"] for r in got} == want
        for most in (clustering.WHOLE_EDGES, 0) if threshold == 0.15 else (clustering.WHOLE_EDGES,):
            monkeypatch.setattr(clustering, "WHOLE_EDGES", most)
            roots = clustering.components(haps, clustering.links(haps, threshold, whole=False)).collect()
            assert {(r["region_ord"], r["hap"]): (r["region_ord"], r["root"]) for r in roots} == {x: root(x) for x in up}
        monkeypatch.undo()


def test_pivots_spare_most_pairs(spark):
    haps, _ = _clustered_haps(spark, 4000, 40, 25, 6, lost=0.05)
    coded = haps.where("region_ord = 3").select("region_ord", "hap", "hap_rank", clustering.token_codes(F.col("seq")).alias("codes"))
    groups = clustering._groups(clustering._placed(coded, 0.15))
    n = coded.count()
    done = clustering.group_pairs(groups, 0.15).agg(F.sum(F.when((F.col("a_cell") == F.col("b_cell")) & (F.col("a_ring") == F.col("b_ring")), F.col("a_n") * (F.col("a_n") - 1) / 2).otherwise(F.col("a_n") * F.col("b_n"))).alias("k")).first()["k"]
    assert done < 0.1 * n * (n - 1) / 2


def test_clusters_of_no_haplotypes(spark):
    haps = spark.createDataFrame([], "region_ord int, seq array<string>, hap_rank int, hap string")
    assert clustering.clusters(haps, 0.2).count() == 0


def test_interval_join_matches_a_plain_one(spark, monkeypatch):
    rng = random.Random(12)

    def some(n, wide):
        out = []
        for i in range(n):
            a = rng.randrange(1 << rng.choice([10, 20, 31]))
            out.append((i, rng.choice(["c1", "c2", None]), a, a + (rng.randrange(1 << rng.choice(wide)) if rng.random() < 0.8 else 0)))
        return out

    a, b = some(250, [3, 12, 22, 33]) + [(900, "c1", 50, 20), (901, "c1", None, 5)], some(250, [2, 15, 18, 27]) + [(902, "c1", 1, 1 << 40)]
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] and x[1] == y[1] and x[2] is not None and x[3] >= y[2] and x[2] <= y[3])
    x = spark.createDataFrame(a, "i int, c string, s long, e long")
    y = spark.createDataFrame(b, "j int, d string, t long, f long")
    got = intervals.overlapping(x, y, [("c", "d")], ("s", "e"), ("t", "f"))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want and got.columns == [*x.columns, *y.columns]
    # many regions take this way, few are literals: the same rows
    records = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(a) if r[2] is not None], "ord long, chrom string, pos long")
    regions = spark.createDataFrame([(i, c, s, e) for i, (_, c, s, e) in enumerate(b) if c], readers.REGION_SCHEMA)
    features = x.select(F.col("c").alias("seqid"), F.col("s").alias("start"), F.col("e").alias("stop"), F.lit("gene").alias("ftype"), F.col("i").alias("feature_ord"))
    found = {}
    for most in (readers.MOST_LITERALS, 10_000, 2):
        monkeypatch.setattr(readers, "MOST_LITERALS", most)
        found[most] = sorted(map(tuple, readers.in_regions(records, regions).select("region_ord", "ord").collect())), sorted(map(tuple, readers.features_in(features, regions).select("region_ord", "feature_ord").collect()))
    assert len(set(map(repr, found.values()))) == 1 and len(found[2][0]) > 50 and len(found[2][1]) > 50


def test_no_bin_holds_a_whole_chromosome(spark):
    x = spark.range(200_000).select(F.lit("c").alias("c"), (F.col("id") * 1000).alias("s"), (F.col("id") * 1000 + 500).alias("e"))
    binned = intervals._binned(x, F.col("s"), F.col("e"), "1").where("_width = _own1")
    assert binned.groupBy("_width", "_bin").count().agg(F.max("count")).first()[0] < 200


def _trait_values(spark, n, seed):
    rng = random.Random(seed)
    rows = [(r, "t", 0, f"c{k}", k, float(rng.randrange(12)) if r else rng.random() * 100) for r in (0, 1) for k in range(5) for _ in range(rng.randrange(3, n))]
    # a class of its own range: it meets others in no part
    rows += [(r, "t", 0, "c9", 9, 1000.0 + i) for r in (0, 1) for i in range(9)] + [(0, "t", 0, "c1", 1, None)]
    return spark.createDataFrame(rows, "region_ord int, trait string, trait_ord int, cls string, ord int, value double").repartition(5), rows


def test_pairwise_and_boxes_over_parts(spark):
    values, rows = _trait_values(spark, 40, 2)
    own = {}
    for r, _, _, cls, _, v in rows:
        if v is not None:
            own.setdefault((r, cls), []).append(v)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts of so few rows
    try:
        got = traits.pairwise(values, ["region_ord"]).collect()
        boxes = {(r["region_ord"], r["cls"]): r for r in traits.box_stats(values, ["region_ord"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(got) == 2 * 15
    for r in got:
        a, b = own[r["region_ord"], r["class1"]], own[r["region_ord"], r["class2"]]
        u = sum((x > y) + (x == y) / 2 for x in a for y in b)
        assert r["u"] == max(u, len(a) * len(b) - u)
        t = Counter(a + b)
        n = len(a) + len(b)
        var = len(a) * len(b) / 12 * ((n + 1) - sum(c**3 - c for c in t.values()) / (n * (n - 1)))
        assert math.isclose(r["z"], (r["u"] - len(a) * len(b) / 2 - 0.5) / math.sqrt(var), rel_tol=1e-12)
    for key, vs in own.items():
        q = np.percentile(vs, [25, 50, 75])
        np.testing.assert_allclose([boxes[key][c] for c in ("q1", "med", "q3")], q, rtol=1e-12)
        reach = 1.5 * (q[2] - q[0])
        assert boxes[key]["n"] == len(vs) and boxes[key]["whislo"] == min(min(v for v in vs if v >= q[0] - reach), q[0]) and boxes[key]["whishi"] == max(max(v for v in vs if v <= q[2] + reach), q[2])


def test_adjustment_and_ranks_over_parts_equal_windows(spark, monkeypatch):
    rng = random.Random(3)
    tests = spark.createDataFrame([(g, i, None if i % 17 == 0 else rng.choice([1.0, 0.5, rng.random() ** 4, rng.random()])) for g in range(3) for i in range(400)], "g int, i int, p double").repartition(4)
    seqs = spark.createDataFrame([(r, [rng.choice("ACGTN") for _ in range(3)], f"s{i}") for r in range(3) for i in range(300)], "region_ord int, seq array<string>, sample string")
    found = []
    for most in (ranges.WHOLE, 0):
        monkeypatch.setattr(ranges, "WHOLE", most)
        adjusted = {(r["g"], r["i"]): r["q"] for r in statistics.benjamini_hochberg(tests, "p", "q", ["g"]).collect()}
        found.append((adjusted, sorted(map(tuple, haplotypes.rank(seqs).select("region_ord", "hap", "n", "seq", "hap_rank").collect()))))
    assert found[0][1] == found[1][1]
    assert found[0][0].keys() == found[1][0].keys()
    for key, q in found[0][0].items():
        assert q == found[1][0][key] if q is None else math.isclose(q, found[1][0][key], rel_tol=1e-14)
    same = {}
    for r in tests.where("p is not null").collect():
        same.setdefault((r["g"], r["p"]), set()).add(found[1][0][r["g"], r["i"]])
    assert all(len(v) == 1 for v in same.values())  # equal p-values stay equal


def test_files_are_ordered_over_parts(spark, tmp_path):
    from locusframe.sources import sinks

    lines = spark.range(20_000).select((F.col("id") % 3).cast("int").alias("region_ord"), F.lit(1).alias("section"), F.col("id").alias("o0"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("line"))
    regions = [{"region_ord": i, "chrom": "c", "start": i + 1, "stop": 9} for i in range(4)]
    merging = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for out in (str(tmp_path / "x"), f"file:{tmp_path}/y/"):  # a plain folder and a URI
            paths = sinks.write_files(spark, out, {"k": (".txt", lines)}, regions)
            for i in range(3):
                assert open(paths[i]["k"].removeprefix("file:")).read() == "".join(f"l{j}\n" for j in range(i, 20_000, 3))
            assert open(paths[3]["k"].removeprefix("file:")).read() == ""
            assert sorted(p.name for p in (tmp_path / out.rstrip("/")[-1]).iterdir()) == [f"c_{i + 1}_9.txt" for i in range(4)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merging)


def test_jobs_do_not_grow_with_regions(spark, files, tmp_path):
    jobs = {}
    for n in (1, 4):
        (tmp_path / "r.tsv").write_text("".join(f"ChrDemo\t{900 + i}\t2900\n" for i in range(n)))
        spark.sparkContext.setJobGroup(f"regions {n}", "x")
        result = Engine(spark).analyze(str(files / "p2.vcf"), str(files / "groups.tsv"), str(tmp_path / f"o{n}"), region_file=str(tmp_path / "r.tsv"))
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"regions {n}"))
        assert len(result.paths) == n
    spark.sparkContext.setJobGroup("", "")
    assert jobs[4] <= jobs[1] + 8, jobs  # a few more exchanges, no set of jobs a region
    a, b = (open(tmp_path / o / "ChrDemo_900_2900.HapSummary.tsv").read() for o in ("o1", "o4"))
    assert a == b


def test_scratch_tables_go_with_their_scope(spark, tmp_path):
    from locusframe.sources import scratch

    with scratch.scope():
        path = scratch.cut(spark.range(3))._lf_path.removeprefix("file://")
        assert os.path.isdir(path)
    assert not os.path.exists(path)


def test_sql_tails_of_large_statistics():
    duckdb = pytest.importorskip("duckdb")
    for h, k, want in [(6530.136922, 7, 0.0), (4192.737204, 5, 0.0), (3.84145882, 2, 0.05), (9.4877290, 5, 0.05), (7.8147279, 4, 0.05), (0.0, 3, 1.0)]:
        assert duckdb.connect().execute(f"SELECT {oracle.CHI_TAIL} FROM (SELECT CAST({h} AS DOUBLE) AS h, {k} AS k)").fetchone()[0] == pytest.approx(want, abs=1e-6)
    for z in (0.3, 1.9, 2.0, 4.5, 8.9, 12.0, 38.0, 60.0):
        assert duckdb.connect().execute(f"SELECT {oracle.NORMAL_TAIL} FROM (SELECT CAST({z} AS DOUBLE) AS z)").fetchone()[0] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_sql_significance_of_large_statistics():
    duckdb = pytest.importorskip("duckdb")
    head = oracle.VALUES + oracle.KRUSKAL.format(k="region_ord, trait") + oracle.MWU
    rows = "SELECT 0 AS region_ord, 'score' AS trait, CAST(13500 AS BIGINT) AS n, 5 AS k, CAST(4192.737204 AS DOUBLE) AS h"
    pairs = "SELECT 0 AS region_ord, 'score' AS trait, 'a' AS class1, 'b' AS class2, CAST(1 AS BIGINT) AS n1, CAST(1 AS BIGINT) AS n2, 0.0 AS mean1, 0.0 AS mean2, 1.0 AS pvalue, 1.0 AS padj"
    found = duckdb.connect().execute(f"WITH kp AS (SELECT *, {oracle.CHI_TAIL} AS pvalue FROM ({rows})), pb AS ({pairs})" + oracle.ORACLES["q38_trait_significance"].removeprefix(head)).fetchall()
    stars = {r[3]: (r[11], r[13]) for r in found}
    assert stars["overall"] == (0.0, "***") and stars["pairwise"][1] == "ns"


def test_sql_places_go_by_p_values(spark):
    duckdb = pytest.importorskip("duckdb")
    # both p-values are the zero of doubles: the display order decides, not z
    rows = [("a", "b", 1, 2, 0.0, 50.0), ("a", "c", 1, 3, 0.0, 60.0), ("b", "c", 2, 3, 0.01, 2.6)]
    values = ", ".join(f"(0, 'score', '{a}', '{b}', {i}, {j}, CAST({p} AS DOUBLE), CAST({p} AS DOUBLE), CAST({z} AS DOUBLE))" for a, b, i, j, p, z in rows)
    pb = f"WITH pb AS (SELECT * FROM (VALUES {values}) t(region_ord, trait, class1, class2, ord1, ord2, pvalue, padj, z))"
    sql = duckdb.connect().execute(pb + oracle.ORACLES["q40_top_annotations"].removeprefix(oracle.VALUES + oracle.MWU)).fetchall()
    table = spark.createDataFrame([(0, "score", "pairwise", a, b, i, j, p, p) for a, b, i, j, p, _ in rows], "region_ord long, trait string, ComparisonType string, Class1 string, Class2 string, ord1 int, ord2 int, pvalue double, padj_BH double")
    found = traits.top_annotations(table, ["region_ord"]).select("region_ord", "trait", "Class1", "Class2", "padj_BH", "place").collect()
    assert sorted(sql) == sorted(map(tuple, found))


@pytest.mark.parametrize("mode", ["inbred", "hybrid"])
def test_cells_of_the_lens_stay_with_their_sample(spark, tmp_path, monkeypatch, mode):
    monkeypatch.setattr(lens, "PART", 100)
    customer = spark.range(1000).select(F.col("id").alias("c_custkey"), F.element_at(F.array(F.lit("BUILDING"), F.lit("FURNITURE")), (F.col("id") % 2 + 1).cast("int")).alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal"))
    customer.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(5).selectExpr("id n_nationkey", "0L n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(1).selectExpr("id r_regionkey", "'R' r_name").write.parquet(f"{tmp_path}/region.parquet")
    seqs = queries.Lens(spark, str(tmp_path), mode).seqs
    assert seqs.count() == 1000 * (2 if mode == "hybrid" else 1)
    # one file is dealt to parts of few samples, and grouping by sample moves no cell
    assert seqs.rdd.getNumPartitions() == 10
    plan = seqs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(sample#") and plan.count("SortMergeJoin") <= 1


def test_copies_of_short_and_missing_genotypes(spark):
    rows = [("s", 0, 1, ["A", "G"], [1, None]), ("s", 0, 0, ["C", "T"], [0]), ("t", 1, 0, ["C", "T"], None), ("t", 1, 1, ["A", "G"], [5])]
    cells = spark.createDataFrame([(7, *r) for r in rows], "region_ord int, sample string, sample_ord int, site_ord int, tokens array<string>, gt array<int>")
    got = {(r["sample"], r["copy"]): r["seq"] for r in haplotypes.sequences(cells, "hybrid").collect()}
    assert got == {("s", 0): ["C", "G"], ("s", 1): ["N", "N"], ("t", 0): ["N", "N"]}


def test_no_task_takes_all_rows_of_a_class(spark):
    rows = spark.range(2_000_000).select(F.lit(0).alias("region_ord"), (F.col("id") % 3).cast("string").alias("cls"), (F.col("id") % 50).cast("double").alias("x"))
    values = traits.long_traits(rows, "cls", ["x"], ["region_ord"])
    plan = values._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    found = traits.kruskal(values, ["region_ord"]).collect()
    assert [(r["trait"], r["n"], r["k"]) for r in found] == [("x", 2_000_000, 3)]


def small_lens(spark, path):
    kinds = F.array(F.lit("BUILDING"), F.lit("FURNITURE"))
    spark.range(1000).select(F.col("id").alias("c_custkey"), F.element_at(kinds, (F.col("id") % 2 + 1).cast("int")).alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal")).coalesce(1).write.parquet(f"{path}/customer.parquet")
    spark.range(5).selectExpr("id n_nationkey", "0L n_regionkey").write.parquet(f"{path}/nation.parquet")
    spark.range(1).selectExpr("id r_regionkey", "'R' r_name").write.parquet(f"{path}/region.parquet")
    return str(path)


@pytest.mark.parametrize("mode", ["inbred", "hybrid"])
def test_samples_of_the_lens_are_not_broadcast(spark, tmp_path, mode):
    x = queries.Lens(spark, small_lens(spark, tmp_path), mode)
    for made in (x.seqs, x.hap_group()):
        assert made.count() == 1000 * (2 if mode == "hybrid" and "seq" in made.columns else 1)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [sample#" not in plan


def test_classes_of_inbred_samples_are_not_grouped(spark):
    copies = spark.createDataFrame([(0, "a", 1, 0, "Hap001"), (0, "b", 2, 0, "Hap002"), (1, "a", 1, 0, "Hap001")], "region_ord int, sample string, sample_ord int, copy int, hap string")
    member = spark.createDataFrame([(0, "Hap001", "C1")], "region_ord int, hap string, cluster string")
    named = haplotypes.classes(copies, member, "inbred")
    assert sorted(map(tuple, named.collect())) == [(0, "a", 1, "Hap001", "C1"), (0, "b", 2, "Hap002", "NA"), (1, "a", 1, "Hap001", "NA")]
    assert "Aggregate" not in named._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "balance,keys,reason",
    [
        # few values without ties, a NaN, and classes without values
        ("CASE WHEN c_custkey IN (1, 14, 40, 53, 92, 105, 118) THEN c_custkey * 1.25::DOUBLE WHEN c_custkey = 9 THEN 'nan'::DOUBLE END", "c_custkey", traits.EMPTY_CLASS),
        ("CAST(7 AS DOUBLE)", "c_custkey", "Kruskal-Wallis failed: all values are the same"),
        ("c_acctbal", "c_custkey * 10", traits.FEW_CLASSES),  # no values at all
    ],
)
def test_significance_of_odd_values_equals_its_sql(spark, tmp_path, balance, keys, reason):
    duckdb = pytest.importorskip("duckdb")
    con, given = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"CREATE TABLE customer AS SELECT * REPLACE (CAST({keys} AS BIGINT) AS c_custkey, {balance} AS c_acctbal) FROM '{given}/customer.parquet'")
    for name in ("customer", "nation", "region"):
        con.execute(f"CREATE TABLE IF NOT EXISTS {name} AS SELECT * FROM '{given}/{name}.parquet'")
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = queries.QUERIES["q38_trait_significance"](spark, str(tmp_path))
    want = con.execute(oracle.ORACLES["q38_trait_significance"])
    assert got.columns == [c[0] for c in want.description]
    have = [tuple(r) for r in got.collect()]
    assert Counter(have) == Counter(want.fetchall())
    assert reason in {r[-1] for r in have} and "NA" in {r[-2] for r in have}
    assert "IN (1" not in balance or any(r[3] == "pairwise" and 0 < min(r[6], r[7]) <= 8 for r in have)


def test_cluster_sizes_of_single_copies_shuffle_no_names(spark):
    copies = spark.createDataFrame([(0, "s1", "a"), (0, "s2", "a"), (0, "s3", "b"), (0, None, "b"), (1, "s1", "a")], "region_ord int, sample string, hap string")
    member = spark.createDataFrame([(0, "a", "x"), (0, "b", "x"), (1, "a", "y")], "region_ord int, hap string, cluster string")
    got = clustering.cluster_sizes(copies, member, once=True)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, clustering.cluster_sizes(copies, member).collect())) == Counter([(0, "x", 3), (1, "y", 1)])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def _refuse(*_):
    raise AssertionError("read without need")


def test_tables_of_groups_take_one_pass_and_no_traits(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(v):
        seen.add(1)
        return v

    rows = [(0, "g1", "a")] * 3 + [(0, "g2", "b")] * 2 + [(0, "g2", "a"), (0, "g1", None), (0, "g3", "c")]
    df = spark.createDataFrame(rows, "region_ord int, grp string, cls string").withColumn("cls", noted("cls"))
    got = {(r["grp"], r["cls"]): (r["n"], r["ord"]) for r in traits.crosstab(df, "cls", "grp", ["region_ord"], 2).collect()}
    assert got == {("g1", "a"): (3, 1), ("g1", "b"): (0, 2), ("g2", "a"): (1, 1), ("g2", "b"): (2, 2)}
    assert seen.value == len(rows)
    monkeypatch.setattr(queries.Lens, "traits", _refuse)
    for name in ("q34_group_proportions", "q35_pie_labels"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns[:3] == ["region_ord", "Type", "ClusterID"]


def test_class_counts_of_the_lens_read_no_groups_and_traits(spark, monkeypatch):
    monkeypatch.setattr(queries.Lens, "traits", _refuse)
    monkeypatch.setattr(queries.Lens, "typed", _refuse)
    rows = queries.QUERIES["q32_class_min_count"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["n"] >= queries.MIN_COUNT for r in rows)


def test_box_values_take_one_pass_and_no_groups(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(v):
        seen.add(1)
        return v

    values = [1.0, 2.0, 3.0, 4.0, 4.0, 100.0, None]
    df = spark.createDataFrame([(0, "t", "a", v) for v in values], "region_ord int, trait string, cls string, v double").select("region_ord", "trait", "cls", noted("v").alias("value"))
    r = traits.box_stats(df, ["region_ord"]).collect()[0]
    assert (r["n"], r["q1"], r["med"], r["q3"], r["whislo"], r["whishi"]) == (6, 2.25, 3.5, 4.0, 1.0, 4.0)
    # the filter of nulls and the grouping may each read the column
    assert seen.value <= 2 * len(values)
    monkeypatch.setattr(queries.Lens, "typed", _refuse)
    assert "whishi" in queries.QUERIES["q39_boxplot_stats"](spark, "/root/testdata/sf0.001").columns


@pytest.mark.parametrize("policy,want", [("slash", ["A/G", "N", "T"]), ("iupac", ["R", "N", "T"]), ("missing", ["N", "N", "T"])])
def test_called_tokens_are_worked_out_once_a_cell(spark, policy, want):
    rows = [(0, "s1", 1, 3, [0, 0], ["T"]), (0, "s1", 1, 1, [0, 1], ["A", "G"]), (0, "s1", 1, 2, None, ["A"])]
    cells = spark.createDataFrame(rows, "region_ord int, sample string, sample_ord long, site_ord long, gt array<int>, tokens array<string>")
    seqs = haplotypes.sequences(cells, "inbred", policy)
    assert [r["seq"] for r in seqs.collect()] == [want]
    assert seqs._jdf.queryExecution().optimizedPlan().toString().count("filter(transform(") == 1
    given = "/root/testdata/sf0.001"
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("filter(transform(")
    assert count(queries.QUERIES["q12_consensus_slash"](spark, given)) == count(queries.Lens(spark, given).cells) + 1


def test_copies_are_read_off_a_row_sorted_once(spark):
    rows = [(0, "s1", 1, 3, [0, 0], ["T"]), (0, "s1", 1, 1, [0, 1, 1], ["A", "G"]), (0, "s1", 1, 2, None, ["A"])]
    cells = spark.createDataFrame(rows, "region_ord int, sample string, sample_ord long, site_ord long, gt array<int>, tokens array<string>")
    seqs = haplotypes.sequences(cells, "hybrid")
    assert {r["copy"]: r["seq"] for r in seqs.collect()} == {0: ["A", "N", "T"], 1: ["G", "N", "T"], 2: ["G", "N", "N"]}
    plan = seqs._jdf.queryExecution().optimizedPlan().toString()
    # sorted where the row is gathered, below the copies
    assert "sort" not in plan[: plan.index("Generate")] and "sort_array" in plan


@pytest.mark.parametrize("name", ["q21_hap_membership", "q30_sample_copy_fasta"])
def test_copies_and_ranks_read_the_same_sequences(spark, name):
    made = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    # the cells are made for the table of sequences only, not again for the rows of the query
    assert "customer.parquet" not in "".join(made.inputFiles())
