"""The same queries as SQL for another engine over the same tables."""

from __future__ import annotations

LENS = """
WITH RECURSIVE st AS (
  SELECT r.r_regionkey AS region_ord, n.n_nationkey AS k, CAST(floor(n.n_nationkey / 5.0) AS INT) AS j,
         r.r_name AS chrom, 100 + 50 * n.n_nationkey AS pos
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
b AS (SELECT *, substr('ACGT', k % 4 + 1, 1) AS b0, substr('ACGT', (k + 1) % 4 + 1, 1) AS b1, substr('ACGT', (k + 2) % 4 + 1, 1) AS b2,
             CASE WHEN j IN (2, 4) THEN 2 ELSE 1 END AS nalt FROM st),
sites AS (
  SELECT region_ord, k AS site_ord, j, k, chrom, pos, nalt,
    CASE WHEN k % 2 = 0 THEN 'v' || k ELSE chrom || ':' || pos END AS vid,
    CASE WHEN j = 3 THEN b0 || 'CGT' ELSE b0 END AS ref,
    CASE j WHEN 0 THEN b1 WHEN 1 THEN b0 || 'TG' WHEN 2 THEN b1 || ',' || b2 WHEN 3 THEN b0 ELSE b1 || ',<PAV>' END AS alt,
    CASE WHEN j = 3 THEN 'REF4' ELSE b0 END AS t0,
    CASE j WHEN 1 THEN '+2' WHEN 3 THEN '-3' ELSE b1 END AS t1,
    CASE j WHEN 2 THEN b2 WHEN 4 THEN 'PAV' END AS t2,
    row_number() OVER (PARTITION BY region_ord ORDER BY k) - 1 AS place
  FROM b),
smp AS (
  SELECT c_custkey, 'S' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS sample, c_mktsegment AS grp, c_acctbal AS balance,
    c_custkey % (3 + length(c_mktsegment) % 5) AS f1,
    CASE WHEN c_custkey % 3 = 0 THEN (c_custkey * 5) % 6 ELSE c_custkey % (3 + length(c_mktsegment) % 5) END AS f2
  FROM customer),
calls AS (
  SELECT s.region_ord, s.site_ord, s.place, s.j, s.k, s.chrom, s.pos, s.t0, s.t1, s.t2, m.c_custkey, m.sample, m.grp,
    CASE WHEN (m.c_custkey * 31 + s.k * 17) % 97 = 0 THEN NULL ELSE ((m.f1 * m.f1 + m.f1 * s.j * (s.j + 1) + 3 * s.j + s.k) % 7) % (s.nalt + 1) END AS a1,
    ((m.f2 * m.f2 + m.f2 * s.j * (s.j + 1) + 3 * s.j + s.k) % 7) % (s.nalt + 1) AS a2
  FROM sites s CROSS JOIN smp m),
tok AS (
  SELECT *, CASE a1 WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE 'N' END AS k1, CASE a2 WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE 'N' END AS k2 FROM calls),
cons AS (
  SELECT *, CASE WHEN k1 = 'N' THEN k2 WHEN k2 = 'N' OR k1 = k2 THEN k1 ELSE k1 || '/' || k2 END AS slash FROM tok)
"""

INBRED = ", seqs AS (SELECT region_ord, sample, CAST(0 AS BIGINT) AS copy, list(slash ORDER BY site_ord) AS seq FROM cons GROUP BY region_ord, sample)"
HYBRID = """, seqs AS (
  SELECT region_ord, sample, CAST(0 AS BIGINT) AS copy, list(k1 ORDER BY site_ord) AS seq FROM tok GROUP BY region_ord, sample
  UNION ALL SELECT region_ord, sample, CAST(1 AS BIGINT), list(k2 ORDER BY site_ord) FROM tok GROUP BY region_ord, sample)"""
HAPS = """, counted AS (SELECT region_ord, seq, count(DISTINCT sample) AS n FROM seqs GROUP BY region_ord, seq),
haps AS (SELECT *, 'Hap' || lpad(CAST(rk AS VARCHAR), CAST(greatest(3, length(CAST(rk AS VARCHAR))) AS INTEGER), '0') AS hap
         FROM (SELECT *, row_number() OVER (PARTITION BY region_ord ORDER BY n DESC, seq) AS rk FROM counted)),
copies AS (SELECT s.region_ord, s.sample, s.copy, h.hap FROM seqs s JOIN haps h ON s.region_ord = h.region_ord AND s.seq = h.seq)"""
LONG = ", long AS (SELECT region_ord, hap, rk, unnest(seq) AS token, unnest(range(len(seq))) AS idx FROM haps)"
PAIRS = """, pairs AS (
  SELECT a.region_ord, a.hap AS hap1, b.hap AS hap2,
    CASE WHEN sum(CASE WHEN a.token <> 'N' AND b.token <> 'N' THEN 1 ELSE 0 END) = 0 THEN 1.0
      ELSE sum(CASE WHEN a.token <> 'N' AND b.token <> 'N' AND a.token <> b.token THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN a.token <> 'N' AND b.token <> 'N' THEN 1 ELSE 0 END) AS DOUBLE) END AS distance
  FROM long a JOIN long b ON a.region_ord = b.region_ord AND a.idx = b.idx AND a.hap < b.hap GROUP BY ALL)"""
CLUSTERS = """, link AS (SELECT region_ord, hap1 AS x, hap2 AS y FROM pairs WHERE distance <= 0.2 UNION ALL SELECT region_ord, hap2, hap1 FROM pairs WHERE distance <= 0.2),
reach AS (SELECT region_ord, hap AS x, hap AS y FROM haps UNION SELECT r.region_ord, r.x, l.y FROM reach r JOIN link l ON r.region_ord = l.region_ord AND r.y = l.x),
root AS (SELECT region_ord, x AS hap, min(y) AS root FROM reach GROUP BY region_ord, x),
clusters AS (SELECT region_ord, hap, 'HapC' || dense_rank() OVER (PARTITION BY region_ord ORDER BY root) AS cluster FROM root)"""
CLUSTERED = LENS + INBRED + HAPS + LONG + PAIRS + CLUSTERS
GROUPED = CLUSTERED + """, trait AS (SELECT sample, CASE WHEN c_custkey % 10 <> 0 THEN balance END AS balance, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey * 7 % 100 + 20 * f1 AS DOUBLE) END AS score FROM smp),
hg AS (SELECT c.region_ord, c.hap AS "Hap", k.cluster AS "ClusterID", c.sample AS "Accession", m.grp AS "Type", t.balance, t.score
       FROM copies c JOIN clusters k ON c.region_ord = k.region_ord AND c.hap = k.hap JOIN smp m ON c.sample = m.sample LEFT JOIN trait t ON c.sample = t.sample),
shown AS (SELECT region_ord, "ClusterID" AS cls, row_number() OVER (PARTITION BY region_ord ORDER BY count(*) DESC, "ClusterID") AS ord
          FROM hg GROUP BY region_ord, "ClusterID" HAVING count(*) >= 20)"""
VALUES = GROUPED + """, vals AS (
  SELECT h.region_ord, s.cls, s.ord, u.trait, u.value FROM hg h JOIN shown s ON h.region_ord = s.region_ord AND h."ClusterID" = s.cls,
  LATERAL (SELECT 'balance' AS trait, h.balance AS value UNION ALL SELECT 'score', h.score) u),
live AS (SELECT * FROM vals WHERE value IS NOT NULL)"""
CROSSTAB = GROUPED + """, kept AS (SELECT h.* FROM hg h JOIN shown s ON h.region_ord = s.region_ord AND h."ClusterID" = s.cls),
cells AS (SELECT g.region_ord, g."Type", s.cls AS "ClusterID" FROM (SELECT DISTINCT region_ord, "Type" FROM kept) g JOIN shown s ON g.region_ord = s.region_ord),
xt AS (SELECT c.*, count(k."Accession") AS n FROM cells c LEFT JOIN kept k ON c.region_ord = k.region_ord AND c."Type" = k."Type" AND c."ClusterID" = k."ClusterID" GROUP BY ALL),
ct AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY region_ord, "Type") AS DOUBLE) AS share FROM xt)"""
COUNTS = LENS + """, cnt AS (
  SELECT region_ord, site_ord, count(*) FILTER (grp = 'BUILDING' AND alt) AS a, count(*) FILTER (grp = 'BUILDING' AND NOT alt) AS b,
         count(*) FILTER (grp = 'AUTOMOBILE' AND alt) AS c, count(*) FILTER (grp = 'AUTOMOBILE' AND NOT alt) AS d
  FROM (SELECT region_ord, site_ord, grp, coalesce(a1, 0) > 0 OR a2 > 0 AS alt FROM calls WHERE grp IN ('BUILDING', 'AUTOMOBILE')) GROUP BY region_ord, site_ord)"""


def fisher(source: str, keys: str) -> str:
    """CTEs that end in ``pv``: the keys with a, b, c, d and pvalue."""
    return f""", pmf AS (
  SELECT {keys}, a, b, c, d, x, exp(lgamma(a+b+1) - lgamma(x+1) - lgamma(a+b-x+1) + lgamma(c+d+1) - lgamma(a+c-x+1) - lgamma(c+d-a-c+x+1)
     - lgamma(a+b+c+d+1) + lgamma(a+c+1) + lgamma(b+d+1)) AS p
  FROM (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM {source})),
pv AS (SELECT {keys}, a, b, c, d, least(1.0, sum(p) FILTER (p <= seen + 1e-12)) AS pvalue
       FROM (SELECT *, max(CASE WHEN x = a THEN p END) OVER (PARTITION BY {keys}) AS seen FROM pmf) GROUP BY {keys}, a, b, c, d)"""


TESTED = COUNTS + fisher("cnt", "region_ord, site_ord") + """, rk AS (
  SELECT *, row_number() OVER (PARTITION BY region_ord ORDER BY pvalue, site_ord) AS r, count(*) OVER (PARTITION BY region_ord) AS m FROM pv),
bh AS (SELECT *, least(1.0, min(pvalue * m / r) OVER (PARTITION BY region_ord ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM rk)"""
STATES = LONG + """, toks AS (SELECT DISTINCT region_ord, idx, token FROM long),
alpha AS (SELECT unnest(range(62)) AS i, substr('ACGTNRYSWKMBDHV0123456789abcdefghijklmnopqrstuvwxyzEFIJLOPQUXZ', i + 1, 1) AS ch),
free AS (SELECT t.region_ord, t.idx, a.ch, row_number() OVER (PARTITION BY t.region_ord, t.idx ORDER BY a.i) AS r
         FROM (SELECT DISTINCT region_ord, idx FROM toks) t CROSS JOIN alpha a
         WHERE NOT EXISTS (SELECT 1 FROM toks x WHERE x.region_ord = t.region_ord AND x.idx = t.idx AND x.token = a.ch AND x.token IN ('A','C','G','T','N'))),
oth AS (SELECT *, row_number() OVER (PARTITION BY region_ord, idx ORDER BY token) AS r FROM toks WHERE token NOT IN ('A','C','G','T','N')),
states AS (SELECT region_ord, idx, token, token AS state FROM toks WHERE token IN ('A','C','G','T','N')
           UNION ALL SELECT o.region_ord, o.idx, o.token, p.ch FROM oth o JOIN free p ON o.region_ord = p.region_ord AND o.idx = p.idx AND o.r = p.r),
codes AS (SELECT l.region_ord, l.hap, string_agg(s.state, '' ORDER BY l.idx) AS code FROM long l JOIN states s ON l.region_ord = s.region_ord AND l.idx = s.idx AND l.token = s.token GROUP BY l.region_ord, l.hap)"""
#: P(Z > z) twice: the error function's series of positive terms up to 2, beyond it the continued
#: fraction of the tail, which keeps its relative precision down to the smallest doubles.
NORMAL_TAIL = """CASE WHEN z <= 0 THEN 1.0 WHEN z < 2 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 100),
  lambda i: exp(2 * i * ln(2) + (2 * i + 1) * ln(z / sqrt(2)) + lgamma(i + 1) - lgamma(2 * i + 2) - z * z / 2)))
  ELSE exp(ln(2 / pi()) / 2 - z * z / 2 - ln(list_reduce(range(200, -1, -1), lambda a, i: z + (i + 1) / a, CAST(z AS DOUBLE)))) END"""
#: Upper tail for whole degrees of freedom k - 1: a finite sum, with the normal tail if they are odd.
CHI_TAIL = """CASE WHEN h <= 0 THEN 1.0 ELSE CASE WHEN k % 2 = 0 THEN """ + NORMAL_TAIL.replace("z", "sqrt(h)") + """ ELSE 0.0 END
  + coalesce(list_sum(list_transform(range(0, (k - 1) // 2), lambda j: exp(-h / 2 + (j + (1 - k % 2) / 2.0) * ln(h / 2) - lgamma(j + (1 - k % 2) / 2.0 + 1)))), 0) END"""
PLAIN_KRUSKAL = """, rnk AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY value) + (count(*) OVER (PARTITION BY {k}, value) - 1) / 2.0 AS r FROM live),
byc AS (SELECT {k}, cls, sum(r) AS rs, count(*) AS n FROM rnk GROUP BY {k}, cls),
sm AS (SELECT {k}, sum(rs * rs / n) AS s, CAST(sum(n) AS DOUBLE) AS n, count(*) AS k FROM byc GROUP BY {k}),
ti AS (SELECT {k}, sum(t * t * t - t) AS ties FROM (SELECT {k}, value, CAST(count(*) AS DOUBLE) AS t FROM live GROUP BY {k}, value) GROUP BY {k}),
kw AS (SELECT {k}, CAST(sm.n AS BIGINT) AS n, sm.k AS k, (12.0 / (sm.n * (sm.n + 1)) * sm.s - 3 * (sm.n + 1)) / (1 - ti.ties / (sm.n * sm.n * sm.n - sm.n)) AS h
FROM sm JOIN ti USING ({k})),
kp AS (SELECT *, """ + CHI_TAIL + """ AS pvalue FROM kw)"""
KRUSKAL_ROWS = "SELECT {k}, n, k, round(h, 6) AS h, round(pvalue, 6) AS pvalue FROM kp"
PLAIN_MWU = """, cl AS (SELECT region_ord, trait, cls, ord, count(value) AS n, avg(value) AS mean FROM vals GROUP BY ALL),
pr AS (SELECT a.region_ord, a.trait, a.cls AS class1, b.cls AS class2, a.ord AS ord1, b.ord AS ord2, a.n AS n1, b.n AS n2, a.mean AS mean1, b.mean AS mean2
       FROM cl a JOIN cl b ON a.region_ord = b.region_ord AND a.trait = b.trait AND a.ord < b.ord),
mm AS (SELECT p.region_ord, p.trait, p.class1, p.class2, l.value, l.cls = p.class1 AS one FROM pr p JOIN live l ON p.region_ord = l.region_ord AND p.trait = l.trait AND l.cls IN (p.class1, p.class2)),
rr AS (SELECT *, rank() OVER (PARTITION BY region_ord, trait, class1, class2 ORDER BY value) + (count(*) OVER (PARTITION BY region_ord, trait, class1, class2, value) - 1) / 2.0 AS r,
         count(*) OVER (PARTITION BY region_ord, trait, class1, class2, value) AS t FROM mm),
ss AS (SELECT region_ord, trait, class1, class2, sum(r) FILTER (one) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM rr GROUP BY ALL),
uu AS (SELECT p.*, CAST(p.n1 AS DOUBLE) * p.n2 AS mn, CAST(p.n1 + p.n2 AS DOUBLE) AS n, s.ties,
         greatest(s.r1 - p.n1 * (p.n1 + 1) / 2.0, CAST(p.n1 AS DOUBLE) * p.n2 - (s.r1 - p.n1 * (p.n1 + 1) / 2.0)) AS u
       FROM pr p LEFT JOIN ss s USING (region_ord, trait, class1, class2)),
zz AS (SELECT *, (u - mn / 2 - 0.5) / sqrt(mn / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM uu),
pz AS (SELECT *, """ + NORMAL_TAIL + """ AS pvalue FROM zz),
pk AS (SELECT *, row_number() OVER (PARTITION BY region_ord, trait ORDER BY z DESC) AS r, count(*) OVER (PARTITION BY region_ord, trait) AS m FROM pz),
pb AS (SELECT *, least(1.0, min(pvalue * m / r) OVER (PARTITION BY region_ord, trait ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM pk)"""
#: The report's rules in full: what is no number is no value, and a trait without values has its row;
#: no test of fewer than two classes, nor where all values are equal.
KRUSKAL = """, held AS (SELECT {k}, cls, ord, CASE WHEN NOT isnan(value) THEN value END AS value FROM vals),
given AS (SELECT * FROM held WHERE value IS NOT NULL)""" + PLAIN_KRUSKAL[: PLAIN_KRUSKAL.index(",\nkp AS")].replace("FROM live", "FROM given") + """,
kn AS (SELECT {k}, coalesce(kw.n, 0) AS n, coalesce(kw.k, 0) AS k, CASE WHEN kw.k >= 2 AND isfinite(kw.h) THEN kw.h END AS h FROM (SELECT DISTINCT {k} FROM held) LEFT JOIN kw USING ({k})),
kp AS (SELECT *, CASE WHEN h IS NOT NULL THEN """ + CHI_TAIL + """ END AS pvalue FROM kn)"""
#: Exact p-values of classes of at most eight values without ties, by the sets of ranks (``size`` of
#: ``size + other``) that reach U; 1 where all values of a pair are equal; null, and no part in the
#: adjustment, where a class has no values.
MWU = """, own AS (SELECT * REPLACE (CASE WHEN NOT isnan(value) THEN value END AS value) FROM vals)""" + (
    PLAIN_MWU[: PLAIN_MWU.index(",\npz AS")].replace("FROM vals", "FROM own").replace("JOIN live l ON", "JOIN own l ON l.value IS NOT NULL AND")
) + """,
small AS (SELECT DISTINCT n1, n2, u FROM uu WHERE ties = 0 AND least(n1, n2) BETWEEN 1 AND 8),
ways AS (SELECT DISTINCT least(n1, n2) AS size, greatest(n1, n2) AS other, 0 AS upto, 0 AS taken, CAST(0 AS BIGINT) AS total, CAST(1 AS DOUBLE) AS w FROM small
  UNION ALL SELECT size, other, upto + 1, taken + x, total + x * (upto + 1), sum(w) FROM ways, (VALUES (0), (1)) t(x)
  WHERE upto < size + other AND taken + x <= size GROUP BY size, other, upto, taken + x, total + x * (upto + 1)),
sets AS (SELECT size, other, total - size * (size + 1) // 2 AS reached, w, sum(w) OVER (PARTITION BY size, other) AS every FROM ways WHERE upto = size + other AND taken = size),
tails AS (SELECT q.n1, q.n2, q.u, least(1.0, 2 * sum(s.w) / any_value(s.every)) AS exact FROM small q
  JOIN sets s ON s.size = least(q.n1, q.n2) AND s.other = greatest(q.n1, q.n2) AND s.reached >= q.u GROUP BY q.n1, q.n2, q.u),
zs AS (SELECT zz.*, exact FROM zz LEFT JOIN tails t ON zz.ties = 0 AND zz.n1 = t.n1 AND zz.n2 = t.n2 AND zz.u = t.u),
pz AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN CASE WHEN exact IS NOT NULL THEN exact WHEN isfinite(z) THEN """ + NORMAL_TAIL + """ ELSE 1.0 END END AS pvalue FROM zs),
pk AS (SELECT *, row_number() OVER (PARTITION BY region_ord, trait ORDER BY pvalue NULLS LAST) AS r, count(pvalue) OVER (PARTITION BY region_ord, trait) AS m FROM pz),
pb AS (SELECT *, CASE WHEN pvalue IS NOT NULL THEN least(1.0, min(pvalue * m / r) OVER (PARTITION BY region_ord, trait ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) END AS padj FROM pk)"""
STARS = "CASE WHEN {p} IS NULL THEN 'NA' WHEN {p} <= 0.001 THEN '***' WHEN {p} <= 0.01 THEN '**' WHEN {p} <= 0.05 THEN '*' ELSE 'ns' END"
FEATURES = """
WITH f AS (
  SELECT r.r_regionkey AS region_ord, r.r_name AS seqid, s.s_suppkey AS key, i, kind, s.s_suppkey * 10 + i AS feature_ord,
    100 + s.s_suppkey * 13 % 1100 + i * 20 AS start,
    100 + s.s_suppkey * 13 % 1100 + i * 20 + CASE WHEN kind = 'gene' THEN 200 ELSE 30 + s.s_suppkey % 40 END AS stop,
    CASE WHEN kind = 'five_prime_utr' THEN 'five_prime_UTR' ELSE kind END AS ftype
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  CROSS JOIN (VALUES (0, 'gene'), (1, 'exon'), (2, 'CDS'), (3, 'five_prime_utr'), (4, 'intron')) k(i, kind)
  WHERE kind <> 'gene' OR s.s_suppkey % 2 = 0),
o AS (SELECT * FROM f WHERE stop >= 300 AND start <= 900 AND ftype <> 'intron'),
g AS (SELECT region_ord, feature_ord, start, stop FROM o WHERE ftype = 'gene'
      UNION ALL SELECT region_ord, 0, min(start), max(stop) FROM o GROUP BY region_ord HAVING count(*) FILTER (ftype = 'gene') = 0),
bl AS (SELECT o.*, greatest(o.start, 300) AS lft, least(o.stop, 900) AS rgt FROM o JOIN g ON o.region_ord = g.region_ord AND o.stop >= g.start AND o.start <= g.stop
       WHERE o.ftype IN ('exon', 'CDS', 'five_prime_UTR'))"""
CONSENSUS = CLUSTERED + """, parts AS (
  SELECT DISTINCT l.region_ord, c.cluster, s.site_ord, u.part FROM long l JOIN clusters c ON l.region_ord = c.region_ord AND l.hap = c.hap
  JOIN sites s ON s.region_ord = l.region_ord AND s.place = l.idx, LATERAL (SELECT unnest(string_split(l.token, '/')) AS part) u),
consensus AS (SELECT region_ord, cluster, site_ord, string_agg(part, '/' ORDER BY part) AS token FROM parts GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "q01_region_scan": LENS + "SELECT chrom, CAST(pos AS BIGINT) AS pos, ref FROM sites WHERE chrom = 'ASIA' AND pos BETWEEN 200 AND 800",
    "q02_multi_region_union": LENS
    + """SELECT CAST(r.o AS BIGINT) AS region_ord, count(*) AS n, CAST(min(pos) AS BIGINT) AS first, CAST(max(pos) AS BIGINT) AS last
FROM sites s JOIN (SELECT region_ord AS c, region_ord AS o, 1 AS lo, 700 AS hi FROM (SELECT DISTINCT region_ord FROM sites)
  UNION ALL SELECT region_ord, region_ord + 5, 500, 100000 FROM (SELECT DISTINCT region_ord FROM sites)) r ON s.region_ord = r.c AND s.pos BETWEEN r.lo AND r.hi GROUP BY r.o""",
    "q03_vcf_roundtrip": LENS
    + "SELECT chrom, CAST(pos AS BIGINT) AS pos, count(*) FILTER (a1 = 0) AS ref1, count(*) FILTER (a1 > 0) AS alt1, count(*) FILTER (a1 IS NULL) AS lost1, count(*) FILTER (a2 > 0) AS alt2 FROM calls GROUP BY ALL",
    "q04_info_parse": """SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey % 5 <> 0 THEN 'x=y' END AS ending, CASE WHEN n_nationkey % 5 <> 0 THEN 'True' END AS flag,
CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey * 3 AS BIGINT) END AS svlen, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 3 END AS BIGINT) AS n FROM nation""",
    "q05_allele_tokens": LENS + "SELECT chrom, CAST(pos AS BIGINT) AS pos, vid, ref, alt, concat_ws(',', t0, t1, t2) AS tokens FROM sites",
    "q06_symbolic_tokens": """WITH x AS (SELECT CASE p_partkey % 10 WHEN 0 THEN '<DEL>' WHEN 1 THEN '<absent>' WHEN 2 THEN '<DUP:TANDEM>' WHEN 3 THEN '<present>' WHEN 4 THEN '<PAV>' WHEN 5 THEN '<X>'
 WHEN 6 THEN '<>' WHEN 7 THEN '*' WHEN 8 THEN '' ELSE 'ACGT' END AS alt, CASE WHEN p_size % 3 = 0 THEN p_size - 24 END AS sv FROM part)
SELECT alt, CASE WHEN alt IN ('*', '') THEN 'N' WHEN alt = 'ACGT' THEN '+3' WHEN sv > 0 THEN '+' || sv WHEN sv < 0 THEN CAST(sv AS VARCHAR)
 WHEN alt IN ('<DEL>', '<absent>') THEN 'DEL' WHEN alt IN ('<DUP:TANDEM>', '<present>') THEN 'INS' WHEN alt = '<PAV>' THEN 'PAV' WHEN alt = '<X>' THEN 'X' ELSE 'SV' END AS token, count(*) AS n FROM x GROUP BY ALL""",
    "q07_genotype_tokens": LENS + "SELECT CAST(site_ord AS BIGINT) AS site_ord, k1 || '/' || k2 AS cell, count(*) AS n FROM tok GROUP BY ALL",
    "q08_ploidy": LENS + "SELECT CAST(region_ord AS BIGINT) AS region_ord, CAST(2 AS BIGINT) AS ploidy, count(DISTINCT sample) AS n FROM calls GROUP BY region_ord",
    "q09_phased_share": LENS
    + "SELECT CAST(site_ord AS BIGINT) AS site_ord, count(*) FILTER (c_custkey % 4 <> 0) AS n_phased, round(count(*) FILTER (c_custkey % 4 <> 0) / CAST(count(*) AS DOUBLE), 6) AS share FROM calls GROUP BY site_ord",
    "q10_sample_pool": LENS + "SELECT sample, c_custkey AS sample_ord FROM smp WHERE grp <> 'MACHINERY'",
    "q11_missingness": LENS
    + "SELECT CAST(region_ord AS BIGINT) AS region_ord, CAST(site_ord AS BIGINT) AS site_ord, count(*) FILTER (k1 = 'N' AND k2 = 'N') AS n_missing, count(*) AS n_samples FROM tok GROUP BY region_ord, site_ord",
    "q12_consensus_slash": LENS + "SELECT CAST(site_ord AS BIGINT) AS site_ord, slash AS token, count(*) AS n FROM cons GROUP BY ALL",
    "q13_consensus_iupac": LENS
    + """SELECT CAST(site_ord AS BIGINT) AS site_ord, CASE WHEN slash IN ('A/G','G/A') THEN 'R' WHEN slash IN ('C/T','T/C') THEN 'Y' WHEN slash IN ('C/G','G/C') THEN 'S' WHEN slash IN ('A/T','T/A') THEN 'W'
 WHEN slash IN ('G/T','T/G') THEN 'K' WHEN slash IN ('A/C','C/A') THEN 'M' ELSE slash END AS token, count(*) AS n FROM cons GROUP BY ALL""",
    "q14_consensus_missing": LENS + "SELECT CAST(site_ord AS BIGINT) AS site_ord, CASE WHEN contains(slash, '/') THEN 'N' ELSE slash END AS token, count(*) AS n FROM cons GROUP BY ALL",
    "q15_carrier_counts": COUNTS + "SELECT CAST(region_ord AS BIGINT) AS region_ord, CAST(site_ord AS BIGINT) AS site_ord, a, b, c, d FROM cnt",
    "q16_fisher": TESTED + "SELECT CAST(region_ord AS BIGINT) AS region_ord, CAST(site_ord AS BIGINT) AS site_ord, round(pvalue, 6) AS pvalue FROM bh",
    "q17_bh": TESTED + "SELECT CAST(region_ord AS BIGINT) AS region_ord, CAST(site_ord AS BIGINT) AS site_ord, round(pvalue, 6) AS pvalue, round(padj, 6) AS padj FROM bh",
    "q18_fisher_keep": TESTED
    + "SELECT CAST(bh.region_ord AS BIGINT) AS region_ord, CAST(bh.site_ord AS BIGINT) AS site_ord, s.vid FROM bh JOIN sites s ON bh.region_ord = s.region_ord AND bh.site_ord = s.site_ord WHERE padj <= 0.05",
    "q19_haps_inbred": LENS + INBRED + HAPS + "SELECT CAST(region_ord AS BIGINT) AS region_ord, hap, n, array_to_string(seq, ' ') AS seq FROM haps",
    "q20_haps_hybrid": LENS + HYBRID + HAPS + "SELECT CAST(region_ord AS BIGINT) AS region_ord, hap, n, array_to_string(seq, ' ') AS seq FROM haps",
    "q21_hap_membership": LENS + HYBRID + HAPS + "SELECT CAST(region_ord AS BIGINT) AS region_ord, sample, copy, hap FROM copies",
    "q22_hamming_pairs": LENS + INBRED + HAPS + LONG + PAIRS + "SELECT CAST(region_ord AS BIGINT) AS region_ord, hap1, hap2, round(distance, 6) AS distance FROM pairs WHERE distance <= 0.2",
    "q23_clusters": CLUSTERED + "SELECT CAST(region_ord AS BIGINT) AS region_ord, hap, cluster FROM clusters",
    "q24_cluster_consensus": CONSENSUS
    + """, sizes AS (SELECT c.region_ord, k.cluster, count(DISTINCT c.sample) AS n FROM copies c JOIN clusters k ON c.region_ord = k.region_ord AND c.hap = k.hap GROUP BY ALL)
SELECT CAST(c.region_ord AS BIGINT) AS region_ord, c.cluster, CAST(c.site_ord AS BIGINT) AS site_ord, c.token, s.n FROM consensus c JOIN sizes s ON c.region_ord = s.region_ord AND c.cluster = s.cluster""",
    "q25_hap_summary": CLUSTERED
    + """SELECT CAST(h.region_ord AS BIGINT) AS region_ord, h.hap AS "Hap", k.cluster AS "ClusterID", array_to_string(h.seq, ' ') AS seq, a.acc AS "Accession", h.n AS "Number"
FROM haps h JOIN clusters k ON h.region_ord = k.region_ord AND h.hap = k.hap JOIN (SELECT region_ord, hap, string_agg(DISTINCT sample, ';' ORDER BY sample) AS acc FROM copies GROUP BY region_ord, hap) a
ON a.region_ord = h.region_ord AND a.hap = h.hap""",
    "q26_hap_group_traits": GROUPED + """SELECT CAST(region_ord AS BIGINT) AS region_ord, "Hap", "ClusterID", "Accession", "Type", round(balance, 6) AS balance, round(score, 6) AS score FROM hg""",
    "q27_diplotype_classes": LENS + HYBRID + HAPS + LONG + PAIRS + CLUSTERS
    + """SELECT CAST(region_ord AS BIGINT) AS region_ord, "Hap", "ClusterID", count(*) AS n FROM (
SELECT c.region_ord, c.sample, string_agg(c.hap, '_' ORDER BY c.hap) AS "Hap", string_agg(DISTINCT k.cluster, '_' ORDER BY k.cluster) AS "ClusterID"
FROM copies c JOIN clusters k ON c.region_ord = k.region_ord AND c.hap = k.hap GROUP BY c.region_ord, c.sample) GROUP BY ALL""",
    "q28_state_map": LENS + INBRED + HAPS + STATES + 'SELECT CAST(region_ord AS BIGINT) AS region_ord, CAST(idx AS BIGINT) AS "at", token, state FROM states',
    "q29_encoded_sequences": LENS + INBRED + HAPS + STATES + "SELECT CAST(region_ord AS BIGINT) AS region_ord, hap, code FROM codes",
    "q30_sample_copy_fasta": LENS + HYBRID + HAPS + STATES
    + "SELECT CAST(c.region_ord AS BIGINT) AS region_ord, '>' || c.sample || '|copy' || (c.copy + 1) || '|' || c.hap AS name, d.code FROM copies c JOIN codes d ON c.region_ord = d.region_ord AND c.hap = d.hap",
    "q31_nexus_phylip": LENS + INBRED + HAPS + STATES
    + """SELECT CAST(h.region_ord AS BIGINT) AS region_ord, h.ntax, CAST(h.nchar AS BIGINT) AS nchar, s.symbols FROM (SELECT region_ord, count(*) AS ntax, max(len(seq)) AS nchar FROM haps GROUP BY region_ord) h
JOIN (SELECT region_ord, string_agg(DISTINCT state, '' ORDER BY state) AS symbols FROM states GROUP BY region_ord) s ON h.region_ord = s.region_ord""",
    "q32_class_min_count": GROUPED
    + """SELECT CAST(region_ord AS BIGINT) AS region_ord, "Hap", count(*) AS n, row_number() OVER (PARTITION BY region_ord ORDER BY count(*) DESC, "Hap") AS ord FROM hg GROUP BY region_ord, "Hap" HAVING count(*) >= 20""",
    "q33_group_class_crosstab": CROSSTAB + """SELECT CAST(region_ord AS BIGINT) AS region_ord, "Type", "ClusterID", n FROM ct""",
    "q34_group_proportions": CROSSTAB + """SELECT CAST(region_ord AS BIGINT) AS region_ord, "Type", "ClusterID", round(share, 6) AS share FROM ct""",
    "q35_pie_labels": CROSSTAB + """SELECT CAST(region_ord AS BIGINT) AS region_ord, "Type", "ClusterID", n, CAST(CASE WHEN share * 100 >= 4 THEN 1 ELSE 0 END AS BIGINT) AS labelled FROM ct WHERE n > 0""",
    "q36_kruskal": VALUES + PLAIN_KRUSKAL.format(k="region_ord, trait") + KRUSKAL_ROWS.format(k="CAST(region_ord AS BIGINT) AS region_ord, trait"),
    "q37_mannwhitney": VALUES + PLAIN_MWU
    + """SELECT CAST(region_ord AS BIGINT) AS region_ord, trait, class1, class2, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(u, 6) AS u, round(z, 6) AS z,
 round(pvalue, 6) AS pvalue, round(padj, 6) AS padj FROM pb""",
    "q38_trait_significance": VALUES + KRUSKAL.format(k="region_ord, trait") + MWU
    + """SELECT CAST(region_ord AS BIGINT) AS region_ord, trait, 'cluster' AS "PlotLevel", 'overall' AS "ComparisonType", 'ALL' AS "Class1", '' AS "Class2", n AS "N1", CAST(NULL AS BIGINT) AS "N2",
 CAST(NULL AS DOUBLE) AS "Mean1", CAST(NULL AS DOUBLE) AS "Mean2", 'Kruskal-Wallis' AS "Test", round(pvalue, 6) AS pvalue, round(pvalue, 6) AS "padj_BH", """ + STARS.format(p="pvalue") + """ AS "Significance",
 CASE WHEN k < 2 THEN 'fewer than two classes with numeric trait values' WHEN h IS NULL THEN 'Kruskal-Wallis failed: all values are the same' ELSE '' END AS "SkippedReason" FROM kp
UNION ALL SELECT region_ord, trait, 'cluster', 'pairwise', class1, class2, n1, n2, round(mean1, 6), round(mean2, 6), 'two-sided Mann-Whitney U', round(pvalue, 6), round(padj, 6), """ + STARS.format(p="padj") + """,
 CASE WHEN n1 > 0 AND n2 > 0 THEN '' ELSE 'one or both classes have no numeric trait values' END FROM pb""",
    "q40_top_annotations": VALUES + MWU
    + """SELECT CAST(region_ord AS BIGINT) AS region_ord, trait, class1 AS "Class1", class2 AS "Class2", round(padj, 6) AS "padj_BH", place FROM (
 SELECT *, row_number() OVER (PARTITION BY region_ord, trait ORDER BY padj, pvalue, ord1, ord2) AS place FROM pb WHERE padj <= 0.05) WHERE place <= 10""",
    "q39_boxplot_stats": VALUES
    + """, qq AS (SELECT region_ord, trait, cls, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM live GROUP BY ALL)
SELECT CAST(q.region_ord AS BIGINT) AS region_ord, q.trait, q.cls, n, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3,
 round(least(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), q1), 6) AS whislo, round(greatest(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), q3), 6) AS whishi
FROM qq q JOIN live l ON q.region_ord = l.region_ord AND q.trait = l.trait AND q.cls = l.cls GROUP BY q.region_ord, q.trait, q.cls, n, q1, med, q3""",
    "q41_gff_overlap": FEATURES + "SELECT seqid, ftype, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(feature_ord AS BIGINT) AS feature_ord FROM o",
    "q42_gene_children": FEATURES + "SELECT CAST(region_ord AS BIGINT) AS region_ord, ftype, count(*) AS n FROM bl GROUP BY ALL",
    "q43_clip_blocks": FEATURES
    + """SELECT DISTINCT CAST(region_ord AS BIGINT) AS region_ord, ftype, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(lft AS BIGINT) AS "left", CAST(rgt AS BIGINT) AS "right",
CAST(greatest(1, rgt - lft + 1) AS BIGINT) AS width, CAST(CASE ftype WHEN 'exon' THEN 0.33 WHEN 'CDS' THEN 0.45 ELSE 0.24 END AS DOUBLE) AS height,
CAST(CASE ftype WHEN 'exon' THEN 0 WHEN 'CDS' THEN 2 ELSE 1 END AS BIGINT) AS priority FROM bl""",
    "q44_attrs_name": FEATURES + "SELECT CAST(feature_ord AS BIGINT) AS feature_ord, CASE key % 3 WHEN 0 THEN 'G' || key WHEN 1 THEN 'N' || key ELSE ftype END AS name FROM o",
    "q45_token_matrix": CONSENSUS
    + """SELECT CAST(region_ord AS BIGINT) AS region_ord, cluster, CAST(site_ord AS BIGINT) AS site_ord, token, dense_rank() OVER (PARTITION BY region_ord ORDER BY
 regexp_replace(token, '([0-9]+)', '0000000000000000000\\1', 'g'), token) - 1 AS code FROM consensus""",
    "q46_variant_connectors": LENS + 'SELECT CAST(region_ord AS BIGINT) AS region_ord, CAST(site_ord AS BIGINT) AS site_ord, CAST(pos AS BIGINT) AS pos, CAST(place + 0.5 AS DOUBLE) AS "column" FROM sites',
    "q47_priority_carriers": """WITH m AS (SELECT o_custkey, ascii(o_orderstatus) AS site_ord, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS alt FROM orders GROUP BY ALL),
cnt AS (SELECT CAST(0 AS BIGINT) AS region_ord, CAST(site_ord AS BIGINT) AS site_ord, count(*) FILTER (c_mktsegment = 'BUILDING' AND alt = 1) AS a, count(*) FILTER (c_mktsegment = 'BUILDING' AND alt = 0) AS b,
 count(*) FILTER (c_mktsegment = 'AUTOMOBILE' AND alt = 1) AS c, count(*) FILTER (c_mktsegment = 'AUTOMOBILE' AND alt = 0) AS d
 FROM m JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') GROUP BY site_ord)"""
    + fisher("cnt", "region_ord, site_ord")
    + "SELECT region_ord, site_ord, a, b, c, d, round(pvalue, 6) AS pvalue FROM pv",
    "q48_price_by_flag": """WITH live AS (SELECT l_returnflag AS cls, 'l_extendedprice' AS trait, l_extendedprice AS value FROM lineitem
 UNION ALL SELECT l_returnflag, 'l_quantity', l_quantity FROM lineitem)""" + PLAIN_KRUSKAL.format(k="trait") + KRUSKAL_ROWS.format(k="trait"),
    "q49_brand_type_crosstab": """WITH s AS (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) >= 2), x AS (SELECT t.p_type, s.p_brand, count(p.p_partkey) AS n
 FROM (SELECT DISTINCT p_type FROM part) t CROSS JOIN s LEFT JOIN part p ON p.p_type = t.p_type AND p.p_brand = s.p_brand GROUP BY ALL)
SELECT p_type, p_brand, n, round(n / CAST(sum(n) OVER (PARTITION BY p_type) AS DOUBLE), 6) AS share FROM x""",
}
