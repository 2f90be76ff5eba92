"""A generated data set: 120 accessions, eight sites, three ploidies.

Founders are haplotypes of whole token rows; accessions carry them by number.
"""

from __future__ import annotations

SITES = [
    (1100, "demoV1", "A", "G,T,C"), (1250, "demoV2", "C", "G,T"), (1450, "demoV3", "A", "ATG,ATTG"), (1700, "demoV4", "T", "C,A,G"),
    (1950, "demoV5", "A", "T,G"), (2200, "demoV6", "G", "A,<PAV>,T"), (2450, "demoV7", "C", "T,G"), (2700, "demoV8", "A", "C,G"),
]
FOUNDERS = [(0, 0, 0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0, 1, 1), (2, 1, 1, 1, 1, 2, 0, 0), (2, 1, 1, 1, 1, 1, 1, 1), (3, 2, 2, 2, 2, 3, 2, 0), (1, 2, 2, 3, 2, 3, 0, 0)]
ACCESSIONS = [f"C{i:03d}" for i in range(1, 61)] + [f"L{i:03d}" for i in range(1, 61)]


def founders_of(i: int, ploidy: int) -> list[int]:
    first = i % 2 if i < 60 else 2 + i % 4
    out = [first] * ploidy
    if i % 17 == 3 and ploidy > 1:
        out[-1] = (first + 1) % 6
    return out


def vcf(ploidy: int) -> str:
    lines = ["##fileformat=VCFv4.2", "##contig=<ID=ChrDemo,length=5000>", "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split() + ACCESSIONS)]
    for k, (pos, vid, ref, alt) in enumerate(SITES):
        cells = ["|".join(str(FOUNDERS[f][k]) for f in founders_of(i, ploidy)) for i in range(len(ACCESSIONS))]
        lines.append("\t".join(["ChrDemo", str(pos), vid, ref, alt, ".", "PASS", "SVTYPE=PAV" if "PAV" in alt else ".", "GT", *cells]))
    return "\n".join(lines) + "\n"


def groups() -> str:
    return "".join(f"{a}\t{'Cultivar' if a[0] == 'C' else 'Landrace'}\n" for a in ACCESSIONS)


def traits() -> str:
    rows = ["Accession\tHeight\tWeight"]
    rows += [f"{a}\t{10 + 3 * founders_of(i, 1)[0] + i % 4}\t{50.5 + i % 7}" for i, a in enumerate(ACCESSIONS) if i != 5]
    return "\n".join(rows) + "\n"


GFF = "\n".join(
    "\t".join(r)
    for r in [
        ("ChrDemo", "s", "gene", "1000", "2800", ".", "+", ".", "ID=g1;Name=DemoGene1"),
        ("ChrDemo", "s", "mRNA", "1000", "2800", ".", "+", ".", "ID=t1;Parent=g1"),
        ("ChrDemo", "s", "exon", "1000", "1300", ".", "+", ".", "ID=e1;Parent=t1"),
        ("ChrDemo", "s", "CDS", "1100", "1300", ".", "+", "0", "ID=c1;Parent=t1"),
        ("ChrDemo", "s", "five_prime_utr", "1000", "1099", ".", "+", ".", "ID=u1;Parent=t1"),
        ("ChrDemo", "s", "intron", "1301", "1400", ".", "+", ".", "ID=i1"),
    ]
) + "\n"
