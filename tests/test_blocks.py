"""Block-compressed and binary variants against the plain text."""

import random

import pytest
from pyspark.sql import functions as F

from locusframe.plans.engine import Engine
from locusframe.sources import blocks, readers
import blockfiles


def variant_text(n=400, samples=5, seed=1):
    rng = random.Random(seed)
    out = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"S{i}" for i in range(samples))]
    for chrom in ("c1", "01", "cX"):
        pos = 0
        for i in range(n):
            pos += rng.choice([1, 7, 900, 30_000])
            alts = rng.choice(["G", "G,T", "ATG", "<PAV>", "."])
            call = lambda: rng.choice(["|", "/"]).join(rng.choice(["0", "1", "."]) for _ in range(rng.choice([1, 2, 2, 3])))
            cells = [f"{call()}:{rng.choice(['1', '300', '70000', '.'])}:{rng.choice(['1,2', '3', '.'])}" for _ in range(samples)]
            info = rng.choice([".", "SVLEN=-12;SVTYPE=PAV", "FLAG;DP=3,70000", "NOTE=some_text"])
            out.append("\t".join([chrom, str(pos), rng.choice([".", f"v{i}"]), rng.choice(["A", "AC"]), alts, ".", ".", info, "GT:DP:AD", *cells]))
    return "\n".join(out) + "\n"


NAMES = ["chrom", "pos", "vid", "ref", "alts", "info", "fmt", "cells"]


def rows(df, ordered=True):
    found = [tuple(r) for r in df.orderBy("ord").select(*NAMES).collect()]
    return found if ordered else sorted(map(repr, found))


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("plain") / "a.vcf"
    path.write_text(variant_text())
    return rows(readers.read_variants(spark, str(path)))


@pytest.mark.parametrize("size", [150, 1000, 65280])
@pytest.mark.parametrize("most", [90, 700, 5000, 1 << 25])
def test_ranges_give_every_line_once(tmp_path, size, most):
    text = variant_text(60)
    for ending in (text, text[:-1], text.replace("\n", "\r\n")):
        path = tmp_path / "a.vcf.gz"
        blockfiles.write_text(path, ending if ending.endswith("\n") else ending + "\n", size)
        if not ending.endswith("\n"):
            path.write_bytes(blockfiles.blocks(ending.encode(), size)[0])
        head = blocks.read_head(str(path))
        assert head.samples == [f"S{i}" for i in range(5)]
        found, places = [], []
        with open(path, "rb") as f:
            n = blocks.file_size(f)
            for r in blocks.plan(str(path), head, False, None, most):
                for at, line in blocks.lines(f, r, n):
                    found.append(line.rstrip(b"\r").decode())
                    places.append(at)
        assert found == [line for line in text.split("\n") if line and not line.startswith("#")]
        assert places == sorted(set(places))


def test_a_line_that_begins_at_a_member(tmp_path):
    # members of whole lines: every range begins where a line does
    lines = [f"c\t{i:05d}" for i in range(300)]
    head = "#CHROM\n"
    raw = b"".join(blockfiles.member(x) for x in [head.encode(), *("".join(x + "\n" for x in lines[i : i + 3]).encode() for i in range(0, 300, 3))]) + blockfiles.END_OF_FILE
    path = tmp_path / "a.vcf.gz"
    path.write_bytes(raw)
    for most in (1, 30, 45, 200, 999):
        with open(path, "rb") as f:
            got = [line.decode() for r in blocks.plan(str(path), blocks.read_head(str(path)), False, None, most) for _, line in blocks.lines(f, r, len(raw))]
        assert got == lines, most


def test_many_tasks_and_equal_rows(spark, tmp_path, plain):
    path = tmp_path / "a.vcf.gz"
    blockfiles.write_text(path, variant_text(), 2000)
    assert readers.variant_format(str(path)) == "blocks"
    df = readers.read_variants(spark, str(path), range_bytes=4000)
    assert df.rdd.getNumPartitions() > 5
    assert rows(df) == plain
    assert [r["sample"] for r in readers.read_header(spark, str(path)).orderBy("sample_ord").collect()] == [f"S{i}" for i in range(5)]
    readers.ingest(spark, f"file:{path}", str(tmp_path / "t"))
    assert rows(readers.read_variants(spark, str(tmp_path / "t"), "parquet"), False) == sorted(map(repr, plain))


@pytest.mark.parametrize("kind", ["tbi", "csi"])
def test_a_region_reads_its_members_only(spark, tmp_path, plain, kind):
    path = tmp_path / "a.vcf.gz"
    blockfiles.write_text(path, variant_text(), 2000, kind, **({"shift": 12, "depth": 6} if kind == "csi" else {}))
    raw = path.read_bytes()
    head = blocks.read_head(str(path))
    for spec in ("01:40000-90000", "c1:1-5", "cX:2000000-9000000", "c1:16384-16385"):
        chrom, start, stop = readers.parse_region(spec)
        want = [r for r in plain if r[0] == chrom and start <= r[1] <= stop]
        found = blocks.plan(str(path), head, False, [(chrom, start, stop)])
        size = sum(min(r.stop >> 16, len(raw)) - (r.start >> 16) for r in found)
        assert size < len(raw) / 4  # compressed bytes that the ranges span
        # all other members are spoilt: whoever read them would fail
        broken, at = bytearray(raw), 0
        while at < len(raw):
            n = blocks.member_size(raw, at)
            used = at <= head.start >> 16 or any(r.start >> 16 <= at <= r.stop >> 16 for r in found)
            if not used:
                broken[at + 18 : at + n] = bytes(n - 18)
            at += n
        path.write_bytes(broken)
        regions = readers.read_regions(spark, spec)
        df = readers.in_regions(readers.read_variants(spark, str(path), regions=regions), regions)
        assert rows(df) == want, spec
        path.write_bytes(raw)
    # long chunks are cut, regions without records are empty
    regions = readers.read_regions(spark, "01:1-9000000")
    df = readers.read_variants(spark, str(path), regions=regions, range_bytes=3000)
    assert df.rdd.getNumPartitions() > 3 and rows(readers.in_regions(df, regions)) == [r for r in plain if r[0] == "01"]
    none = readers.read_regions(spark, "nowhere:1-9")
    assert readers.read_variants(spark, str(path), regions=none).count() == 0


@pytest.mark.parametrize("indexed", [False, True])
def test_binary_variants_equal_text(spark, tmp_path, plain, indexed):
    path = tmp_path / "a.bcf"
    blockfiles.write_binary(path, variant_text(), 3000, indexed)
    assert readers.variant_format(str(path), "cyvcf2") == "bcf"
    df = readers.read_variants(spark, str(path), range_bytes=6000)
    assert rows(df) == plain
    assert (df.rdd.getNumPartitions() > 1) == indexed
    regions = readers.read_regions(spark, "01:40000-90000")
    near = readers.read_variants(spark, str(path), regions=regions)
    want = [r for r in plain if r[0] == "01" and 40000 <= r[1] <= 90000]
    assert rows(readers.in_regions(near, regions)) == want
    if indexed:
        assert near.count() < len(plain) / 4
    assert [r["sample"] for r in readers.read_header(spark, str(path)).orderBy("sample_ord").collect()] == [f"S{i}" for i in range(5)]


def test_headers_by_number_and_odd_entries():
    lines = ['##contig=<ID=b,length=3,IDX=1>', '##contig=<ID=a,IDX=0>']
    assert blocks._numbered(lines, ("contig",), []) == ["a", "b"]
    import numpy as np

    floats = np.array([1.5, 0.0, 0.0], "<f4")
    floats.view("<u4")[1:] = [blocks.FLOAT_MISSING, blocks.FLOAT_CLOSED]
    assert blocks.shown(floats, 5) == "1.5,." and blocks.shown(np.frombuffer(b"ab\0", "S1"), 7) == "ab"
    assert blocks.genotype(np.array([2, 5, -127], "i1"), 1) == "0|1" and blocks.genotype(np.array([-128, -127], "i1"), 1) == "."


def test_other_gzip_and_bad_binary(spark, tmp_path, plain):
    import gzip

    with gzip.open(tmp_path / "a.vcf.gz", "wt") as f:
        f.write(variant_text())
    assert readers.variant_format(str(tmp_path / "a.vcf.gz")) == "plain"
    assert rows(readers.read_variants(spark, str(tmp_path / "a.vcf.gz"))) == plain
    (tmp_path / "b.bcf").write_bytes(b"none")
    with pytest.raises(readers.InputError):
        readers.variant_format(str(tmp_path / "b.bcf"))


def test_analysis_of_binary_and_compressed_files(spark, tmp_path):
    text = variant_text(40)
    (tmp_path / "a.vcf").write_text(text)
    blockfiles.write_text(tmp_path / "a.vcf.gz", text, 2000, "tbi")
    blockfiles.write_binary(tmp_path / "a.bcf", text, 2000, True)
    made = {}
    for name in ("a.vcf", "a.vcf.gz", "a.bcf"):
        out = Engine(spark).prepare(str(tmp_path / name), str(tmp_path / name.replace(".", "_")), "01:1-200000")
        made[name] = [open(p).read() for p in out[0]]
    assert made["a.vcf"] == made["a.vcf.gz"] == made["a.bcf"] and len(made["a.vcf"][0].splitlines()) > 5
