"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation, decontam, embed_dedup, html_extract, langid, ngram_join, pii, piece_bpe, suffix_dedup, toxicity, url_filter, whitening
from .common import table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pii_key(spark: SparkSession) -> str:
    """The session's secret.  Without one a warning says that the public key of the
    synthetic tables is used: its pseudonyms can be inverted by anybody."""
    key = spark.conf.get("spark.locusframe.pii.key", None)
    if not key:
        warnings.warn("spark.locusframe.pii.key is not set: the public key of the synthetic tables is used", stacklevel=2)
    return key or "key of the synthetic tables"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False, keep_text=False)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spark, table(spark, sf_dir, "documents"), percent=90, words=3)


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark, table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymize(docs, pii_key(spark), found_col="found")
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), F.array_join(F.transform("found", lambda s: s["kind"]), ",").alias("kinds"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(spark, table(spark, sf_dir, "documents"), length=100, keep_bytes=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, table(spark, sf_dir, "documents"))


def op11_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair(spark, table(spark, sf_dir, "conversations"), damage=True)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(PIECES), keep_pieces=False, keep_text=False)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"), components=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_html_extract": op2_html_extract,
    "op3_ngram_join": op3_ngram_join,
    "op4_embed_dedup": op4_embed_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_pii": op6_pii,
    "op7_decontam": op7_decontam,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_langid": op10_langid,
    "op11_conversation": op11_conversation,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_whitening": op13_whitening,
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
# written out once more, so that the SQL can find an error in the operator's list
_WORDS = "casino|porn|adult|xxx|poker|bets|gambling|viagra|pills|torrent|malware|phishing|spam|ads|doubleclick|adserver"


def _put(state: str, cost: str, edit: str) -> str:
    return f"{{'c': {state}.c + {cost}, 't': {state}.t || '{edit}'}}"


def _with_inserts(x: str) -> str:
    """Repair states (none, s, u, a) with at most one more insert before the next row."""
    return f"[{x}[1], {x}[2], list_min([{x}[3], {_put(x + '[1]', '2', 'I')}, {_put(x + '[2]', '2', 'I')}, {_put(x + '[4]', '2', 'I')}]), list_min([{x}[4], {_put(x + '[3]', '2', 'I')}])]"


def _fits(role: str) -> str:
    return f"CASE WHEN NOT r.x AND r.i = '{role}' THEN r.e ELSE 1000000000 END"


_REROLED = "CASE WHEN r.x THEN 1000000000 ELSE 2 + r.e END"
#: One row of the repair: from the states j, inserts included, to those behind it.
_ROW = f"""[{_put("j[1]", "3", "D")},
  list_min([{_put("j[2]", "3", "D")}, {_put("j[1]", _fits("s"), "K")}]),
  list_min([{_put("j[3]", "3", "D")}, {", ".join(_put(f"j[{i}]", cost, edit) for i in (1, 2, 4) for cost, edit in ((_REROLED, "R"), (_fits("u"), "K")))}]),
  list_min([{_put("j[4]", "3", "D")}, {_put("j[3]", _REROLED, "R")}, {_put("j[3]", _fits("a"), "K")}])]"""

#: SQL for the queries that it can express over whole tables.
ORACLES: dict[str, str] = {
    "op3_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.x, p.y FROM p JOIN n a ON p.x = a.doc_id JOIN n b ON p.y = b.doc_id WHERE 100 * p.k >= 90 * (a.n + b.n - p.k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM documents d JOIN r ON d.doc_id = r.x LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op4_embed_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id) AS n_links, min(r.y) AS component_id, e.vec_id = min(r.y) AS kept FROM embeddings e JOIN r ON e.vec_id = r.x GROUP BY e.vec_id""",
    "op5_url_filter": f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_LOWER}) AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(?i)(^|[^A-Za-z0-9])({_WORDS})([^A-Za-z0-9]|$)|/wp-admin(/|$)|/track/click(/|$)') THEN 'block' ELSE 'allow' END AS verdict FROM j""",
    "op11_conversation": rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
k AS (SELECT o.*, xor(list_reduce(list_transform(string_split(k, ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 20 AS kind FROM o, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
f AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair,
  CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM p),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'r': role, 't': text, 'i': left(role, 1), 'x': coalesce(fault IN ('blank', 'duplicate'), false), 'e': CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END}} ORDER BY place) AS rs FROM f GROUP BY conv_id),
s AS (SELECT conv_id, rs, 0 AS n, [{{'c': CAST(0 AS BIGINT), 't': ''}}, {{'c': 1000000000, 't': ''}}, {{'c': 1000000000, 't': ''}}, {{'c': 1000000000, 't': ''}}] AS x FROM g
  UNION ALL SELECT conv_id, rs, n + 1, list_transform([{{'x': x, 'r': rs[n + 1]}}], lambda v: list_transform([{_with_inserts("v.x")}], lambda w: list_transform([{_with_inserts("w")}], lambda j: list_transform([v.r], lambda r: {_ROW})[1])[1])[1])[1]
  FROM s WHERE n < len(rs)),
b AS (SELECT conv_id, rs, list_min([x[1], {_put("x[2]", "4", "II")}, {_put("x[3]", "2", "I")}, x[4]]) AS best FROM s WHERE n = len(rs)),
e AS (SELECT conv_id, best.c AS cost, best.t AS audit, flatten(list_transform(regexp_extract_all(best.t, 'I*[KRD]'), lambda y, i: list_transform(string_split(y, ''), lambda z: {{'z': z, 'i': i}}))) AS done,
  len(regexp_extract(best.t, 'I*$')) AS closing, rs FROM b),
h AS (SELECT conv_id, cost, audit, list_concat(list_transform(list_filter(done, lambda y: y.z <> 'D'), lambda y: {{'z': y.z, 'r': rs[y.i].r, 't': CASE WHEN y.z = 'I' THEN '' ELSE rs[y.i].t END}}),
  list_transform(range(closing), lambda y: {{'z': 'I', 'r': '', 't': ''}})) AS ls FROM e),
w AS (SELECT conv_id, cost, audit, sha256(coalesce(array_to_string(list_transform(ls, lambda y, i: CASE WHEN y.z = 'K' THEN y.r WHEN (i + CASE WHEN ls[1].z = 'K' AND starts_with(ls[1].r, 's') THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || y.t), chr(10)), '')) AS repaired_sha256 FROM h)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
