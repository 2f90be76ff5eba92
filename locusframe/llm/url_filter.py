"""URL filter: pattern rules found by their rarest literal token.

Every rule is a regular expression with the literal tokens that any match must
contain.  Token counts over all urls name each rule's rarest token; a url's
own tokens then fetch the few candidate rules, and only those run their
expression.  Host-and-path rules are such rules too; the longest that fits
decides.  If none fits, the url patterns decide: one hit blocks.

All of it is DataFrame functions.  Up to ``MOST_INLINE`` rules are a literal map
inside the expression, so judging is a narrow map over the pages.  A longer list
is a table that the distinct urls' tokens are joined to; it is broadcast only if
its size is under ``BROADCAST_BYTES``.  Only the token counts, one row per rule
token, are aggregated and read by the driver.

Defined results: null, or no ``://``: host and path are empty, no rule, and
the verdict is the patterns' over the empty string (allow).  Urls of any length
are judged whole; ids pass through, be they null, repeated or strings; repeated
rows give equal results; extra columns do not matter; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_INLINE = 1_000
BROADCAST_BYTES = 16 << 20
#: Patterns up to this number are compiled once for a task.
MOST_LITERAL = 256


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` for a host rule, else ``pattern`` on host + path."""

    verdict: str
    host: str | None = None
    path: str | None = None
    pattern: str | None = None
    literals: tuple[str, ...] = ()

    @property
    def label(self) -> str:
        return f"{self.host}{self.path}" if self.host is not None else str(self.pattern)

    @property
    def tokens(self) -> tuple[str, ...]:
        if self.host is not None:
            return tuple(t for t in re.split(r"[^a-z0-9]+", f"{self.host}{self.path}".lower()) if t)
        return tuple(t.lower() for t in self.literals)


# fixed values: the host and path rules asked for
HOST_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

# fixed values: words that mark unwanted urls when they stand as a token
PATTERN_WORDS = (
    "casino", "porn", "adult", "xxx", "poker", "bets", "gambling", "viagra", "pills", "torrent", "malware", "phishing", "spam", "ads", "doubleclick", "adserver"
)
PATTERN_RULES = tuple(
    Rule("block", pattern=rf"(?i)(?:^|[^A-Za-z0-9]){w}(?:[^A-Za-z0-9]|$)", literals=(w,)) for w in PATTERN_WORDS
) + (Rule("block", pattern=r"(?i)/wp-admin(?:/|$)", literals=("wp", "admin")), Rule("block", pattern=r"(?i)/track/click(?:/|$)", literals=("track", "click")))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.translate(F.concat(host, path), _UPPER, _LOWER), "[^a-z0-9]+"))


def _index(base: DataFrame, rules: list[Rule]) -> list[tuple[str, int]]:
    """(rarest token, place) of each rule, by the counts over all urls."""
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = base.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    if len(wanted) <= MOST_INLINE:
        tokens = tokens.where(F.col("token").isin(wanted))
    else:
        own = base.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
        tokens = tokens.join(_sized(own, sum(map(len, wanted))), "token", "left_semi")
    counts = {r["token"]: r["n"] for r in tokens.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), k) for k, r in enumerate(rules)]


def _sized(table: DataFrame, size: int) -> DataFrame:
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _fits(rule: Column, rules: list[Rule]) -> Column:
    """Whether a rule fits the row's host and path; only patterns run as expressions."""
    on_host = (F.col("host") == rule["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), rule["host"]))
    where = F.concat("host", "path")
    patterns = [(k, r.pattern) for k, r in enumerate(rules) if r.host is None]
    if len(patterns) <= MOST_LITERAL:
        hit = F.lit(False)
        for k, pattern in patterns:
            hit = F.when(rule["place"] == k, where.rlike(pattern)).otherwise(hit)
    else:
        hit = F.regexp(where, rule["pattern"])
    return F.when(rule["host"].isNotNull(), on_host & F.startswith(F.col("path"), rule["path"])).otherwise(hit)


_RULE = "len int, label string, verdict string, host string, path string, pattern string, place int"


def _row(r: Rule, place: int) -> tuple:
    return len(r.label), r.label, r.verdict, r.host, r.path if r.host is None else r.path or "", r.pattern, place


def _inline(base: DataFrame, rules: list[Rule], index: list[tuple[str, int]]) -> DataFrame:
    """``base`` with (own, other): the deciding host rule and pattern."""
    by_token: dict[str, list[int]] = {}
    for token, k in index:
        by_token.setdefault(token, []).append(k)
    kinds = [c.split() for c in _RULE.split(", ")]
    as_struct = lambda k: F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(_row(rules[k], k), kinds, strict=True)])
    if not by_token:
        none = F.lit(None).cast(f"struct<{_RULE.replace(' ', ':').replace(',:', ',')}>")
        return base.withColumn("own", none).withColumn("other", none)
    lookup = F.create_map(*[x for token, found in sorted(by_token.items()) for x in (F.lit(token), F.array(*map(as_struct, found)))])
    tokens = F.array_intersect(_tokens(F.col("host"), F.col("path")), F.array(*map(F.lit, sorted(by_token))))
    hits = F.filter(F.flatten(F.transform(tokens, lambda t: F.element_at(lookup, t))), lambda r: _fits(r, rules))
    out = base.withColumn("hits", hits)
    return out.withColumn("own", F.array_max(F.filter("hits", lambda r: r["host"].isNotNull()))).withColumn("other", F.array_min(F.filter("hits", lambda r: r["host"].isNull())))


def _joined(base: DataFrame, rules: list[Rule], index: list[tuple[str, int]]) -> DataFrame:
    """The same by a join of the distinct urls' tokens with a table of the rules."""
    rows = [(token, *_row(rules[k], k)) for token, k in index]
    table = base.sparkSession.createDataFrame(rows, f"token string, {_RULE}")
    table = _sized(table.select("token", F.struct(*[c.split()[0] for c in _RULE.split(", ")]).alias("rule")), sum(len(str(r)) for r in rows))
    tokens = base.select("host", "path").distinct().select("host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    hits = tokens.join(table, "token").where(_fits(F.col("rule"), rules))
    is_host = F.col("rule.host").isNotNull()
    found = hits.groupBy("host", "path").agg(F.max(F.when(is_host, F.col("rule"))).alias("own"), F.min(F.when(~is_host, F.col("rule"))).alias("other"))
    return base.join(found, ["host", "path"], "left")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: tuple[Rule, ...] = HOST_RULES, pattern_rules: tuple[Rule, ...] = PATTERN_RULES, default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, pattern) for every row of ``pages``."""
    rules = [*host_rules, *pattern_rules]
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    host, path = host_path(pages[url_col])
    base = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    index = _index(base, rules)
    out = (_inline if len(rules) <= MOST_INLINE else _joined)(base, rules, index)
    return out.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("own.label").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.col("other.verdict"), F.lit(default)).alias("verdict"),
        F.col("other.label").alias("pattern"),
    )
