"""PII: format-preserving Feistel pseudonyms.

Personal values are found by pattern, validated, and replaced by a keyed
permutation of the same format, so equal values stay linked over documents and
the text keeps its shape:

* payment cards: 16 digits, or 13, 14, 15 or 19 with an issuer's first digits; the
  check digit must hold (Luhn); all but the last digit are permuted, and the
  last is set right;
* phones: the digits after ``+``, or of ten-digit forms; separators are kept;
* IPv4 addresses: four octets of at most 255; a permutation of the 32 bits;
* social security style numbers ``ddd-dd-dddd``: digits, separators kept;
* dates ``yyyy-mm-dd`` and ``dd.mm.yyyy``/``dd/mm/yyyy``: valid calendar days
  from 1900 to 2099 are permuted among those days;
* IBANs: the remainder by 97 must be right; letters and length are kept, the
  account's digits are permuted, and the two check digits are set right.

Two kinds of value have no fixed range to permute, so they get keyed digests:

* e-mail addresses: the local part becomes as many hexadecimal digits (twelve at
  least), the host becomes ``example.invalid``;
* secrets after ``token =``, ``key =``, ``secret =`` or ``password =``: 16 or more
  hexadecimal digits, or 12 or more letters and digits with some of both, become
  as many hexadecimal digits.

A value that fails its validation stays as it is.  A balanced Feistel network
permutes [0, A*B); its round function is SHA-256 under the key, which the caller
gives and which must be kept secret: whoever has it can invert the permutations.
Values outside a wanted range are walked through the cycle until they fall in it,
so it stays a permutation.  All of it is DataFrame expressions, evaluated in place
in one narrow map: no shuffle, no Python on the executors.

Defined results: a null text stays null with no values found; an empty text
stays empty; texts and values of any length are handled whole; other columns,
whatever their names, and ids of any kind pass through; repeated rows give equal
results; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6

# fixed values: the formats looked for, the more particular ones first
# A host is labels up to the last place where a top-level name of letters can begin.
# Repeated groups are possessive: they are walked in a loop, where a greedy one
# takes a stack frame for each label.
_LABEL = r"[A-Za-z0-9][A-Za-z0-9-]*+\."
_HOST = rf"(?:(?:{_LABEL}(?![A-Za-z]{{2}}))*+{_LABEL}(?=[A-Za-z]{{2}}))++[A-Za-z]{{2,}}"
_NAMED = r"(?i:token|key|secret|password) ?[=:] ?\"?"
PATTERNS = {
    "secret": _NAMED + r"(?:[0-9A-Fa-f]{16,}(?![0-9A-Za-z])|(?=[A-Za-z_+/.-]*[0-9])(?=[0-9_+/.-]*[A-Za-z])[0-9A-Za-z_+/.-]{12,})",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@" + _HOST,
    "date": r"(?<![\w.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![\w-]|\.[0-9])",
    "ssn": r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "ip": r"(?<![\w.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![\w]|\.[0-9])",
    "phone": r"(?<![\w])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w.-])[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.)[0-9]{4}(?![\w-])",
    "iban": r"(?<![\w])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![\w])",
    "card": r"(?<![\w.-])(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|3[0689][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{4}|4[0-9]{12}|6[0-9]{18})(?![\w-])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _keyed(key: str, tag: str, size: Column, *parts: Column) -> Column:
    """A keyed function of the parts to [0, size): 60 bits of SHA-256."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), *[p.cast("string") for p in parts]), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)


def _digest(key: str, tag: str, value: Column, n: Column) -> Column:
    """The first n hexadecimal digits of a keyed digest of any length."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 64).cast("int")), lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), value), 256))
    return F.substring(F.array_join(pieces, ""), F.lit(1), n)


def permute_number(x: Column, a: Column, b: Column, key: str, tag: str) -> Column:
    """A keyed permutation of [0, a*b): x = left * b + right, alternating sums.

    Odd rounds add to the left modulo a, even rounds to the right modulo b.
    """
    left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
    # x / b is a double: exact below 2**53, and both factors stay under 2**26
    start = F.struct(left.alias("l"), right.alias("r"))

    def step(s: Column, i: Column) -> Column:
        odd = F.pmod(i, F.lit(2)) == 1
        return F.struct(
            F.when(odd, F.pmod(s["l"] + _keyed(key, tag, a, i, s["r"]), a)).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + _keyed(key, tag, b, i, s["l"]), b)).alias("r"),
        )

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return end["l"] * b + end["r"]


def walk_number(x: Column, a: int, b: int, size: int, key: str, tag: str, steps: int = 64) -> Column:
    """A permutation of [0, size) inside [0, a*b): walk the cycle into it."""
    la, lb = F.lit(a).cast("long"), F.lit(b).cast("long")
    first = permute_number(x, la, lb, key, tag)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), first, lambda v, _: F.when(v < size, v).otherwise(permute_number(v, la, lb, key, tag))
    )


def _pow10(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(16)]), n + 1)


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A permutation of the digit strings of each length.

    Strings are cut in blocks of at most 14 digits, each permuted with the
    text before it as part of the key; one digit is permuted modulo ten.
    """

    def block(s: Column, salt: Column) -> Column:
        n = F.length(s)
        half = F.floor(n / 2).cast("int")
        a, b = _pow10(half), _pow10(n - half)
        left, right = F.coalesce(F.substring(s, F.lit(1), half).try_cast("long"), F.lit(0)), F.coalesce(F.substring(s, half + 1, n - half).try_cast("long"), F.lit(0))

        def step(st: Column, i: Column) -> Column:
            odd = F.pmod(i, F.lit(2)) == 1
            fl = _keyed(key, tag, a, n, salt, i, st["r"])
            fr = _keyed(key, tag, b, n, salt, i, st["l"])
            return F.struct(
                F.when(odd, F.pmod(st["l"] + fl, a)).otherwise(st["l"]).alias("l"),
                F.when(odd, st["r"]).otherwise(F.pmod(st["r"] + fr, b)).alias("r"),
            )

        end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.alias("l"), right.alias("r")), step)
        return F.concat(F.when(half > 0, F.lpad(end["l"].cast("string"), half, "0")).otherwise(F.lit("")), F.lpad(end["r"].cast("string"), n - half, "0"))

    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)), F.lit(14))
    return F.array_join(
        F.transform(at, lambda i: block(F.substring(digits, i, F.lit(14)), F.concat(F.length(digits).cast("string"), F.lit(":"), F.substring(digits, F.lit(1), i - 1)))), ""
    )


def pour(shape: Column, digits: Column) -> Column:
    """Put a string's digits into the digit places of ``shape``, in order."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        chars,
        start,
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.between("0", "9"), F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + F.when(c.between("0", "9"), 1).otherwise(0)).alias("at"),
        ),
    )["out"]


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of the digits, every other doubled from the right end."""
    n = F.length(digits)

    def weigh(c: Column, i: Column) -> Column:
        from_right = n - 1 - i
        twice = F.pmod(from_right, F.lit(2)) == (0 if doubled_last else 1)
        d = c.cast("int")
        return F.when(twice, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    chars = F.filter(F.split(digits, ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, weigh), F.lit(0), lambda s, d: s + d)


def _only_digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _card(v: Column, key: str) -> Column:
    d = _only_digits(v)
    body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(body, True), F.lit(10)), F.lit(10))
    valid = F.pmod(_luhn_sum(d, False), F.lit(10)) == 0
    return F.when(valid, pour(v, F.concat(body, check.cast("string")))).otherwise(v)


def _digits_kept(tag: str) -> Callable[[Column, str], Column]:
    return lambda v, key: pour(v, permute_digits(_only_digits(v), key, tag))


def _mod97(s: Column) -> Column:
    """The remainder of digits and letters (A is 10, Z is 35) read as one number."""

    def step(r: Column, c: Column) -> Column:
        return F.pmod(F.when(c.between("0", "9"), r * 10 + c.try_cast("int")).otherwise(r * 100 + F.ascii(c) - 55), F.lit(97))

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), step)


def _iban(v: Column, key: str) -> Column:
    flat = F.replace(v, F.lit(" "), F.lit(""))
    country, rest = F.substring(flat, 1, 2), flat.substr(F.lit(5), F.length(flat))
    valid = _mod97(F.concat(rest, F.substring(flat, 1, 4))) == 1
    account = pour(rest, permute_digits(_only_digits(rest), key, "iban"))
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, pour(v, F.concat(check, _only_digits(account)))).otherwise(v)


def _ip(v: Column, key: str) -> Column:
    parts = F.split(v, r"\.")
    nums = F.transform(parts, lambda p: p.cast("long"))
    whole = F.aggregate(nums, F.lit(0).cast("long"), lambda s, o: s * 256 + o)
    p = permute_number(whole, F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip")
    octets = [F.pmod(F.shiftright(p, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(F.forall(nums, lambda o: o <= 255), F.concat_ws(".", *octets)).otherwise(v)


# fixed values: the days from 1900-01-01 to 2099-12-31
FIRST_DAY, DAYS = "1900-01-01", 73_049


def _date(v: Column, key: str) -> Column:
    iso = v.rlike(r"^[0-9]{4}-")
    sep = F.substring(v, 3, 1)
    text = F.when(iso, v).otherwise(F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2)))
    day = F.datediff(text.try_cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), walk_number(day, 271, 272, DAYS, key, "date").cast("int"))
    shown = F.when(iso, F.date_format(moved, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(moved, "dd"), sep, F.date_format(moved, "MM"), sep, F.date_format(moved, "yyyy")))
    return F.when(day.between(0, DAYS - 1), shown).otherwise(v)


def _email(v: Column, key: str) -> Column:
    n = F.greatest(F.length(F.substring_index(v, "@", 1)), F.lit(12))
    return F.concat(_digest(key, "email", F.lower(v), n), F.lit("@example.invalid"))


def _secret(v: Column, key: str) -> Column:
    value = F.regexp_extract(v, _NAMED + "(.*)$", 1)
    return F.concat(F.substring(v, F.lit(1), F.length(v) - F.length(value)), _digest(key, "secret", value, F.length(value)))


REPLACERS: dict[str, Callable[[Column, str], Column]] = {
    "secret": _secret,
    "email": _email,
    "date": _date,
    "ssn": _digits_kept("ssn"),
    "ip": _ip,
    "phone": _digits_kept("phone"),
    "iban": _iban,
    "card": _card,
}


def kind_of(v: Column) -> Column:
    """The first format that the whole value has."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(v.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(v: Column, kind: Column, key: str) -> Column:
    out = v
    for k in reversed(KINDS):
        out = F.when(kind == k, REPLACERS[k](v, key)).otherwise(out)
    return out


def pseudonymize(df: DataFrame, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """``df`` with personal values in ``text_col`` replaced, columns as before.

    ``found_col`` adds an array of (kind, value, pseudonym) of what was replaced.
    """
    if not key:
        raise ValueError("give a key: pseudonyms without one can be inverted by anybody")
    text = df[text_col]
    # cheap signs first: most texts hold no value of these formats
    named = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(_NAMED)
    maybe = text.rlike("[0-9][0-9.]") | F.contains(text, F.lit("@")) | named
    values = F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = F.transform(
        F.transform(values, lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value"))),
        lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), pseudonym(s["value"], s["kind"], key).alias("pseudonym")),
    )
    cols = df.columns
    hidden = "_lf_pii_seen"
    step = df.select(*[df[c] for c in cols], found.alias(hidden))
    gaps = F.split(F.col(text_col), ANY, -1)
    # gaps are one more than values: they interleave
    joined = F.array_join(
        F.zip_with(gaps, F.transform(F.col(hidden), lambda s: s["pseudonym"]), lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), ""
    )
    new = F.when(F.size(hidden) > 0, joined).otherwise(F.col(text_col))
    out = [new.alias(c) if c == text_col else F.col(c) for c in cols]
    if found_col:
        out.append(F.filter(hidden, lambda s: s["value"] != s["pseudonym"]).alias(found_col))
    return step.select(*out)
