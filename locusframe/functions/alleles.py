"""Allele and genotype expressions.  Everything stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "N"
LITERAL_LIMIT = 20

# fixed values: two- to four-base sets and their one-letter codes
AMBIGUITY = {
    "AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M",
    "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N",
}


def parse_info(info: Column) -> Column:
    """``k=v;flag`` to a map; flags read "True", the last repeat wins."""
    items = F.filter(F.split(F.when(info == ".", F.lit("")).otherwise(F.coalesce(info, F.lit(""))), ";"), lambda s: s != "")
    pairs = F.transform(
        items,
        lambda s: F.when(s.contains("="), F.struct(F.substring_index(s, "=", 1).alias("key"), s.substr(F.instr(s, "=") + 1, F.length(s)).alias("value"))).otherwise(
            F.struct(s.alias("key"), F.lit("True").alias("value"))
        ),
    )
    at = F.sequence(F.lit(0), F.size(pairs) - 1)
    keys = F.transform(pairs, lambda p: p["key"])
    last = F.when(
        F.size(pairs) > 0, F.transform(F.filter(at, lambda i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), F.get(keys, i))), lambda i: F.get(pairs, i))
    ).otherwise(F.filter(pairs, lambda _: F.lit(False)))
    return F.map_from_entries(last)


def info_int(info: Column, key: str) -> Column:
    """The first comma item of a value as an integer, else null."""
    return F.trim(F.split(info[key], ",")[0]).try_cast("int")


def _symbolic(allele: Column) -> Column:
    return allele.startswith("<") & allele.endswith(">")


def _bases(text: Column, letters: str) -> Column:
    return (F.length(text) <= LITERAL_LIMIT) & text.rlike(f"^[{letters}]*$")


def symbolic_token(allele: Column, svlen: Column) -> Column:
    """A signed length if there is one, else the kind the name tells."""
    name = F.upper(F.regexp_replace(allele, "^[<>]+|[<>]+$", ""))
    has = lambda *words: F.lit(False) if not words else _any(name, words)
    return (
        F.when(svlen.isNotNull() & (svlen != 0), F.format_string("%+d", svlen))
        .when(has("DEL", "ABS"), "DEL")
        .when(has("INS", "DUP", "PRE"), "INS")
        .when(has("PAV"), "PAV")
        .when(name == "", "SV")
        .otherwise(name)
    )


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def ref_token(ref: Column, alts: Column) -> Column:
    """The sequence for plain sites, else the length."""
    r = F.when(F.coalesce(ref, F.lit("")) == "", F.lit("N")).otherwise(ref)
    uneven = F.exists(alts, lambda a: _symbolic(a) | (~a.isin("", ".", "*") & (F.length(a) != F.length(r))))
    length = F.concat(F.lit("REF"), F.length(r).cast("string"))
    return (
        F.when(uneven & (F.length(r) > 1), length).when(_bases(F.upper(r), "ACGTN."), F.translate(F.upper(r), ".", "N")).otherwise(length)
    )


def alt_token(ref: Column, alt: Column, svlen: Column) -> Column:
    """P5: a base, a signed length, or the kind of a symbolic allele."""
    r = F.when(F.coalesce(ref, F.lit("")) == "", F.lit("N")).otherwise(ref)
    more = F.length(alt) - F.length(r)
    return (
        F.when(alt.isin("", ".", "*"), MISSING)
        .when(_symbolic(alt), symbolic_token(alt, svlen))
        .when(more != 0, F.format_string("%+d", more))
        .when(_bases(F.upper(alt), "ACGTN"), F.upper(alt))
        .otherwise(F.concat(F.lit("SEQ"), F.length(alt).cast("string")))
    )


def encode_alleles(ref: Column, alts: Column, svlen: Column) -> Column:
    """The tokens of a site, REF first."""
    return F.concat(F.array(ref_token(ref, alts)), F.transform(alts, lambda a: alt_token(ref, a, svlen)))


def decode_genotype(fmt: Column, cell: Column) -> Column:
    """Allele indices of a sample cell; null where missing."""
    at = F.array_position(F.split(fmt, ":"), "GT").cast("int") - 1
    gt = F.when(at >= 0, F.get(F.split(cell, ":"), at))
    gt = F.when(F.coalesce(gt, F.lit("")) == "", F.lit(".")).otherwise(gt)
    return F.transform(F.split(gt, r"[|/]"), lambda x: x.try_cast("int"))


def is_phased(fmt: Column, cell: Column) -> Column:
    """Whether the genotype is written with a bar."""
    at = F.array_position(F.split(fmt, ":"), "GT").cast("int") - 1
    return F.coalesce(F.contains(F.get(F.split(cell, ":"), at), F.lit("|")) & (at >= 0), F.lit(False))


def allele_token(tokens: Column, index: Column) -> Column:
    """The token of an allele index; missing outside the site's alleles."""
    return F.coalesce(F.when(index >= 0, F.get(tokens, index)), F.lit(MISSING))


def genotype_tokens(tokens: Column, genotype: Column) -> Column:
    """P10: tokens of all alleles; none for a missing sample."""
    return F.transform(F.coalesce(genotype, F.array().cast("array<int>")), lambda i: allele_token(tokens, i))


def called_tokens(tokens: Column) -> Column:
    """The distinct tokens of a genotype that are not missing."""
    return F.array_distinct(F.filter(tokens, lambda t: t != MISSING))


def consensus(tokens: Column, policy: str = "slash") -> Column:
    """One token for a sample's site under a heterozygote policy."""
    return consensus_of(called_tokens(tokens), policy)


def consensus_of(called: Column, policy: str = "slash") -> Column:
    """P11 of the ``called_tokens``.

    They are read several times: over many cells they should be a column, not an
    expression that each reading works out again.
    """
    joined = F.array_join(called, "/")
    if policy == "slash":
        mixed = joined
    elif policy == "missing":
        mixed = F.lit(MISSING)
    elif policy == "iupac":
        codes = F.create_map(*[F.lit(x) for kv in AMBIGUITY.items() for x in kv])
        plain = F.forall(called, lambda t: t.isin("A", "C", "G", "T"))
        mixed = F.when(plain, F.coalesce(codes[F.array_join(F.array_sort(called), "")], joined)).otherwise(joined)
    else:
        raise ValueError(f"unknown heterozygote policy: {policy}")
    return F.when(F.size(called) == 0, MISSING).when(F.size(called) == 1, called[0]).otherwise(mixed)


def variant_id(vid: Column, chrom: Column, pos: Column) -> Column:
    """The id, or chrom:pos."""
    return F.when(F.coalesce(vid, F.lit(".")).isin("", "."), F.concat_ws(":", chrom, pos.cast("string"))).otherwise(vid)


def hamming(a: Column, b: Column) -> Column:
    """Share of differing sites among those where neither is missing."""
    pair = F.zip_with(a, b, lambda x, y: F.when((x == MISSING) | (y == MISSING), F.lit(None).cast("int")).when(x == y, 0).otherwise(1))
    seen = F.filter(pair, lambda v: v.isNotNull())
    return F.when(F.size(seen) == 0, F.lit(1.0)).otherwise(F.aggregate(seen, F.lit(0), lambda s, v: s + v) / F.size(seen))
