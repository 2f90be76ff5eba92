"""Each operator against a brute-force version, a round trip or held-out rows."""

import collections
import datetime
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.llm import bpe, common, decontam, embed_dedup, html_extract, langid, ngram_join, pii, suffix_dedup, toxicity, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, None, None, None) for i, t in enumerate(texts)]
    # an extra column whose name some step may use too
    return spark.createDataFrame(rows, DOC).withColumn("doc", F.lit(1)).withColumn("component", F.lit("x")).withColumn("kind", F.lit(None).cast("string"))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


ODD = [None, "", " ", "\n\t ", "a", "a b", "a b c", "é" * 300, "word " * 4000, "x" * 20000, "<|endoftext|> a<|endoftext|>", "don't!'s  \u00a0 y\u00e0 z", "日本語 😀 text", "a\x00b"]


# ------------------------------------------------------------------ components


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 50)]
    uf = common.UnionFind()
    for a, b in edges:
        if a != b:
            uf.join(a, b)
    got = {r["id"]: r["component"] for r in common.components(spark, spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: uf.find(x) for x in list(uf.up)}
    assert common.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_filter_drops_no_id(spark):
    some = spark.range(0, 5000).select((F.col("id") * 7 - 9).alias("doc"))
    ids = some.where("doc % 3 = 0")
    assert common.maybe_in(spark, some, "doc", ids).join(ids, "doc").count() == ids.count()


# ------------------------------------------------------------------ 1 BPE


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "don't", "'s", "!'s", "q", "Z", "é", "à", "\u00a0", "<|endoftext|>", "中", "😀", "12", "%%%", "\r\n", "THe", "hh", "kq", "\x85"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600)]
    got = by_id(bpe.encode_decode(docs(spark, texts), PATH))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded"] == tok.decode(ids, skip_special_tokens=False) == (t or "")
    assert bpe.encode_decode(docs(spark, []), PATH).count() == 0


def test_bpe_cuts_are_certain():
    b = bpe.ForcedBoundaryBPE(PATH)
    assert "".join(b.units("one two  three\n four à b")) == "one two  three\n four à b"
    encode = lambda t: b.tok.encode(t, add_special_tokens=False).ids
    rng = random.Random(12)
    letters = ["q", "x", "Z", "j", "é", "ß", "中", "я", "v", "k", "7", "½", "٣", "%", "'", "'s", "'re", "!", "😀", "€", "_", "\u0301", "ll", "t"]
    seen = collections.Counter()
    for _ in range(3000):
        unit = rng.choice(["", " "]) + "".join(rng.choice(letters) for _ in range(rng.randrange(2, 12)))
        parts = b.fragments(unit)
        assert "".join(parts) == unit and [i for p in parts for i in encode(p)] == encode(unit)
        seen.update(bpe.kind(p[-1]) + bpe.kind(q[0]) for p, q in zip(parts, parts[1:], strict=False))
    # cuts inside runs of letters, digits and signs, and between them
    assert {"LL", "NN", "PP", "LN", "NL", "LP", "PL", "NP", "PN"} <= set(seen)


def test_bpe_ids_of_rows(spark):
    rows = spark.createDataFrame([(2**60 + 1, "a b"), (None, "a b"), (2**60 + 1, "a b")], "doc_id long, text string")
    got = bpe.encode_decode(rows.repartition(1), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 2), (2**60 + 1, 2), (2**60 + 1, 2)]
    named = bpe.encode_decode(rows.withColumn("doc_id", F.lit("x")), PATH).collect()
    assert [r["doc_id"] for r in named] == ["x"] * 3


# ------------------------------------------------------------------ 2 HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>First
 bold.<br><p>Second&nbsp;&lt;x&gt;</p><aside>side</aside><section class="comments"><p>me too</p></section><form><p>mail</p></form></article><footer>&copy; foot</footer>"""


def test_html_article(spark):
    rows = [(0, "http://h.example/a", PAGE), (1, None, None), (2, "http://h.example/b", ""), (0, "http://h.example/a", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit(1))
    got = html_extract.extract(df).collect()
    assert len(got) == 4
    want = "Head & line\n\nFirst bold.\n\nSecond <x>"
    for r in got:
        assert r["text"] == (want if r["page_id"] == 0 else "") and r["n_chars"] == len(r["text"])
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_host_repeats_without_article(spark):
    line = "This site uses small files kept by your reader to count visits each day"
    rows = [(i, f"http://one.example/{i}", f"<body><div>{line}</div><div>story {i} " + " ".join(f"w{i}x{k}" for k in range(30)) + "</div></body>") for i in range(4)]
    rows += [(9, "http://two.example/", f"<body><div>{line}</div></body>")]
    got = by_id(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert all(line not in got[i]["text"] and f"story {i} " in got[i]["text"] for i in range(4))
    assert got[9]["text"] == line


def test_html_host_repeats_beside_an_article(spark):
    line = "This site uses small files kept by your reader to count visits each day"
    own = lambda i, c: " ".join(f"{c}{i}x{k}" for k in range(20))
    rows = [(i, f"http://one.example/{i}", f"<body><div>{line}</div><div>{own(i, 'l')}</div><article><p>{own(i, 'a')}</p></article></body>") for i in range(3)]
    got = by_id(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert all(got[i]["text"] == f"{own(i, 'l')}\n\n{own(i, 'a')}" for i in range(3))


def test_html_cuts_runs_out_of_blocks(spark):
    line = "This site uses small files kept by your reader to count visits each day"
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    # mostly repeated, and mostly unique
    rows = [(i, f"http://one.example/{i}", f"<body><div>{own(i, n)} {line}</div></body>") for i, n in enumerate((4, 40))]
    got = by_id(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert [got[i]["text"] for i in range(2)] == [own(0, 4), own(1, 40)]


def test_html_repeats_over_a_whole_host(spark):
    rng = random.Random(31)
    line = "This site uses small files kept by your reader to count visits each day"
    # more pages than any window, and the line on the first and the last alone
    plain = [[f"<div>{' '.join(f'{i}x{k}' for k in range(12))}</div>"] for i in range(700)]
    plain[0].append(f"<div>{line}</div>")
    plain[-1].append(f"<div>{line}</div>")
    mixed = [[f"<p>{' '.join(rng.choice('abc') for _ in range(rng.randrange(30)))}</p>" for _ in range(3)] for _ in range(12)]
    rows = [(i, f"http://one.example/{i}", f"<body>{''.join(p)}</body>") for i, p in enumerate(plain)]
    rows += [(1000 + i, f"http://two.example/{i}", f"<body>{''.join(p)}</body>") for i, p in enumerate(mixed)]
    rows += [(5000, "http://three.example/", f"<body><div>{line}</div></body>")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, many = (sorted(map(tuple, html_extract.extract(df.repartition(n)).collect())) for n in (1, 40))
    got = {r[0]: r[2] for r in one}
    assert one == many and len(one) == len(rows) and got[5000] == line
    assert all(got[i] == " ".join(f"{i}x{k}" for k in range(12)) for i in range(700))
    # the second host against the suffix array of all its pages
    blocks = [html_extract.blocks_of("".join(p)) for p in mixed]
    tokens = [[t for b in bs for t in ("<" + b.element, *b.text.split())] + [("end", i)] for i, bs in enumerate(blocks)]
    names = {t: n for n, t in enumerate(dict.fromkeys(t for ts in tokens for t in ts))}
    page = np.repeat(np.arange(12), [len(ts) for ts in tokens])
    covered = html_extract.repeated(np.array([names[t] for ts in tokens for t in ts]), page)
    assert [got[1000 + i] for i in range(12)] == [html_extract.main_text(bs, covered[page == i], html_extract.LEAST_RUN) for i, bs in enumerate(blocks)]


def test_repeated_runs_brute_force():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 3, 400)
    page = np.repeat(np.arange(8), 50)
    want = np.zeros(400, bool)
    seen = collections.defaultdict(set)
    for i in range(400 - 4):
        seen[tuple(tokens[i : i + 5])].add(page[i])
    for i in range(400 - 4):
        if len(seen[tuple(tokens[i : i + 5])]) > 1:
            want[i : i + 5] = True
    assert (html_extract.repeated(tokens, page, 5) == want).all()


def test_html_malformed_tags_and_odd_rows(spark):
    texts = {
        "<article><p title=it's>Hello</p></article>": "Hello",
        '<article><p title="a > b" x=\'c > d\'>Hi</p><p a="b>c</p>': "Hi\n\nc",
        '<article><p data-x=1"2>One<br/>two</p>': "One two",
        "<article>3 < 4 and <> 5 <p/>next": "3 < 4 and <> 5\n\nnext",
        "<article><p>" + "word " * 60_000 + "</p></article>": ("word " * 60_000).strip(),
        "no tags": "no tags", "<p": "", "<!-- <article> -->x": "x",
    }
    rows = [(None if k == 2 else f"p{k}", f"http://h{k}.example/", t) for k, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(1)
    got = sorted((str(r["page_id"]), r["text"]) for r in html_extract.extract(df).collect())
    assert got == sorted([(str(None if k == 2 else f"p{k}"), t) for k, t in enumerate(texts.values())] * 2)


# ------------------------------------------------------------------ 3 n-gram join


def plain_join(texts, percent, words):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    uf = common.UnionFind()
    for i, a in enumerate(sets):
        uf.find(i)
        for j in range(i):
            k = len(a & sets[j])
            if a and k and 100 * k >= percent * (len(a) + len(sets[j]) - k):
                uf.join(i, j)
    return [(len(s), uf.find(i)) for i, s in enumerate(sets)]


def near_copies(rng, n_groups=8, copies=6):
    out = []
    common_line = " ".join(f"licence{k}" for k in range(40))
    for g in range(n_groups):
        base = [f"g{g}w{rng.randrange(60)}" for _ in range(rng.choice([3, 8, 20, 60, 150]))]
        for _ in range(copies):
            v = list(base)
            for _ in range(rng.randrange(5)):
                v[rng.randrange(len(v))] = f"new{rng.randrange(9)}"
            out.append(" ".join(v) + (" " + common_line if rng.random() < 0.4 else ""))
    return out


@pytest.mark.parametrize("percent,words", [(90, 3), (80, 5)])
@pytest.mark.parametrize("block", [None, 150])
def test_join_brute_force(spark, percent, words, block, monkeypatch):
    if block:  # many blocks a family
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    texts = [None, "", "one", "One", "one two", "ONE TWO", "  "] + near_copies(random.Random(percent)) + ["a b c d e f g"] * 9
    got = by_id(ngram_join.jaccard_components(spark, docs(spark, texts).repartition(3), percent, words))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == plain_join(texts, percent, words)
    assert ngram_join.jaccard_components(spark, docs(spark, [])).count() == 0


def test_join_of_odd_ids(spark):
    a, b = "one two three four five", "six seven eight nine ten eleven"
    got = ngram_join.jaccard_components(spark, docs(spark, [a, a, b, b, a, None, b], [3, 5, 5, 2, None, None, 5]))
    rows = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str)
    # both texts of id 5 are judged, and rows without an id take part in no group
    assert rows == sorted([(3, 3, 3), (5, 3, 3), (5, 4, 2), (2, 4, 2), (None, 3, None), (None, 0, None), (5, 4, 2)], key=str)
    with pytest.raises(TypeError, match="integers"):
        ngram_join.jaccard_components(spark, docs(spark, [a]).withColumn("doc_id", F.lit("x")))


def overlapping(lists):
    """Pairs whose intervals overlap in some list, joined as the two sides of the shuffle join them."""
    uf = common.UnionFind()
    for rows in lists.values():
        rows.sort(key=lambda r: (r[0], -r[1]))
        n, reach = (np.array([r[i] for r in rows], np.int64) for i in range(2))
        first, _ = ngram_join._overlaps(np.zeros(len(rows), np.int64), n, reach)
        for k, new in enumerate(first):
            if not new:
                uf.join(rows[k][2], rows[k - 1][2])
    return uf


def test_sets_have_a_pair_more_than_can_be_parted():
    order = np.zeros(ngram_join.SLOTS, np.uint8)
    for percent in (75, 80, 90, 95, 100):
        for n in [*range(2, 120), 999, 5000]:
            keys, reach = ngram_join.prefix(np.arange(n, dtype=np.uint64), order, percent)
            for m in range(-(-n * percent // 100), n * 100 // percent + 1):
                overlap = -(-percent * (n + m) // (100 + percent))
                assert overlap == n == m or len(keys) > 2 * n + m - 3 * overlap
                assert overlap == n == m or reach[2 * n + m - 3 * overlap] >= m or m < n


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_linked_sets_meet_in_a_list(percent):
    rng = np.random.default_rng(2)
    order = rng.integers(0, 9, ngram_join.SLOTS).astype(np.uint8)
    vocab = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = []
    for n in list(range(1, 40)) + [100, 333, 900]:
        for _ in range(4):
            a = np.unique(rng.choice(vocab, n))
            drop = rng.integers(0, len(a) * (100 - percent) // 100 + 1)
            sets += [a, a[drop:], np.unique(np.concatenate((a, rng.choice(vocab, n * (100 - percent) // 150))))]
    lists = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for e, r in zip(*ngram_join.prefix(s, order, percent), strict=True):
            lists[int(e)].append((len(s), int(r), i))
    uf, links = overlapping(lists), 0
    for i, a in enumerate(sets):
        for j in range(i):
            k = len(np.intersect1d(a, sets[j]))
            if k and k < max(len(a), len(sets[j])) and 100 * k >= percent * (len(a) + len(sets[j]) - k):
                links += 1
                assert uf.find(i) == uf.find(j)
    assert links > 100


def test_runs_of_a_list_do_not_depend_on_batches():
    rng = np.random.default_rng(6)
    rows = sorted((int(rng.integers(0, 4)), int(n), -int(n + rng.integers(-1, 6))) for n in rng.integers(1, 200, 300))
    key, n, reach = (np.array(c, np.int64) * f for c, f in zip(zip(*rows, strict=True), (1, 1, -1), strict=True))
    whole = ngram_join._overlaps(key, n, reach)
    for cut in (1, 7, 100, 299):
        one = ngram_join._overlaps(key[:cut], n[:cut], reach[:cut])
        two = ngram_join._overlaps(key[cut:], n[cut:], reach[cut:], (int(key[cut - 1]), int(one[1][-1])))
        for w, x, y in zip(whole, one, two, strict=True):
            assert (w == np.concatenate((x, y))).all()


def test_search_of_a_block_probes_long_lists():
    rng = np.random.default_rng(4)
    vocab = np.sort(rng.integers(0, 1 << 63, 600).astype(np.uint64))
    sets = []
    for _ in range(12):
        base = rng.choice(vocab, 200, replace=False)
        sets += [np.unique(np.concatenate((base[rng.integers(0, 40) :], rng.choice(vocab, 9)))) for _ in range(9)]
    ids = list(range(len(sets)))
    for percent in (80, 90):
        uf, want = common.UnionFind(), common.UnionFind()
        ngram_join.search_block(ids, sets, ids, percent, uf)
        for i in ids:
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                    want.join(i, j)
        assert [uf.find(i) for i in ids] == [want.find(i) for i in ids]


# ------------------------------------------------------------------ 4 embeddings


def test_embeddings_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE_ROWS", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 24))
    vectors = np.concatenate([b + rng.normal(scale=s, size=(15, 24)) for b, s in zip(base, np.linspace(0.01, 0.4, 12), strict=True)] + [np.repeat(base[:1], 40, 0)])
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] * 24, 1), (n + 3, rows[0][1], None), (n + 4, [1.0, None], 1), (n + 5, [float("inf")] * 24, 1), (n + 6, [], 1), (n + 7, [1.0, 2.0], 1), (n + 8, [2.0, 4.0], 1)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
    df = spark.createDataFrame(rows, schema).withColumn("rep", F.lit("clash"))
    got = by_id(embed_dedup.near_duplicates(spark, df), "vec_id")
    x = np.array([r[1] for r in rows[:n]], np.float32).astype(np.float64)
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    link = (cos >= 0.98) & (np.arange(n)[:, None] % 2 == np.arange(n)[None] % 2) & ~np.eye(n, dtype=bool)
    uf = common.UnionFind()
    for i, j in zip(*np.nonzero(link), strict=True):
        uf.join(int(i), int(j))
    for i in range(n):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (int(link[i].sum()), uf.find(i), uf.find(i) == i)
    for i in range(n, n + 7):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[n + 8]["n_links"], got[n + 8]["component_id"]) == (1, n + 7)
    assert embed_dedup.near_duplicates(spark, df.limit(0)).count() == 0


def test_embeddings_at_the_threshold(spark):
    # 49 / 50 is the threshold itself; the next one is just below
    rows = [(1, [1, 0, 0, 0]), (2, [49, 7, 7, 1]), (3, [0, 0, 0, 1]), (4, [49, 7, 7, 1.001]), (5, [0, 0, 0, 3e38]), (5, [0, 0, 0, 1e-38]), (None, [1, 0, 0, 0])]
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(spark, df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2, 2, 1, False), (3, 2, 3, True), (4, 1, 1, False), (5, 2, 3, False), (5, 2, 3, False), (None, 0, None, True)], key=str)
    with pytest.raises(TypeError, match="integers"):
        embed_dedup.near_duplicates(spark, df.withColumn("vec_id", F.lit("x")))


def test_stars_span_what_links_connect():
    rng = np.random.default_rng(9)
    x, y = rng.permutation(100)[:40], 100 + rng.permutation(100)[:50]
    link = rng.random((40, 50)) < 0.02
    want, got = common.UnionFind(), common.UnionFind()
    for i, j in zip(*np.nonzero(link), strict=True):
        want.join(int(x[i]), int(y[j]))
    for a, b in zip(*embed_dedup._stars(x, y, link), strict=True):
        got.join(int(a), int(b))
    assert all(want.find(v) == got.find(v) for v in [*x.tolist(), *y.tolist()])


# ------------------------------------------------------------------ 5 urls


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Example.COM/en/x?y#z", "a.example.com", "/en/x", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://x.www.example.com/en/a", "x.www.example.com", "/en/a", "www.example.com/en/", "allow"), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"), ("http://b.net/ES/1", "b.net", "/ES/1", None, "allow"), ("http://b.net", "b.net", "", None, "allow"),
        ("http://com", "com", "", None, "allow"), ("http://com/", "com", "/", "com/", "allow"), ("mailto:x", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://play.casino.org/a", "play.casino.org", "/a", None, "block"), ("http://casinoroyale.org/a", "casinoroyale.org", "/a", None, "allow"), ("http://h.org?x://y/z", "h.org", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url)], "page_id long, url string").withColumn("host", F.lit("clash"))
    r = url_filter.judge(df).collect()[0]
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def plain_judge(url, host_rules, pattern_rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    own = max(((len(r.host + r.path), r.host + r.path, r.verdict) for r in host_rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), default=None)
    hit = any(re.search(r.pattern, host + path) for r in pattern_rules)
    return host, path, own and own[1], own[2] if own else "block" if hit else "allow"


@pytest.mark.parametrize("inline", [1000, 0])
def test_many_url_rules(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filter, "MOST_INLINE", inline)
    rng = random.Random(18)
    label = lambda: rng.choice("abcdef") + rng.choice(["", "x", "y1"])
    hosts = tuple(url_filter.Rule(rng.choice(["allow", "block"]), ".".join(label() for _ in range(rng.randrange(1, 4))), rng.choice(["", "/", "/a/", "/a/b.c"])) for _ in range(120))
    hosts = tuple({(r.host, r.path): r for r in hosts}.values())
    urls = [rng.choice(["http://", "x://", ""]) + ".".join(label() for _ in range(rng.randrange(1, 5))) + rng.choice(["", "/", "/a/", "/a/b?c", "/a/bXc", "/casino/", "/A/wp-admin"]) for _ in range(400)]
    urls += [None, "", "http://a.b/" + "long/" * 9000 + "casino/", urls[0]]
    ids = [None if i == 5 else f"p{i % 390}" for i in range(len(urls))]
    df = spark.createDataFrame(list(zip(ids, urls, strict=True)), "page_id string, url string").withColumn("rule", F.lit(1)).repartition(3)
    got = collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, host_rules=hosts).collect())
    assert got == collections.Counter((i, *plain_judge(u, hosts, url_filter.PATTERN_RULES)) for i, u in zip(ids, urls, strict=True))
    assert url_filter.judge(df.limit(0), host_rules=hosts).count() == 0


# ------------------------------------------------------------------ 6 personal data


def luhn(d):
    return sum(c if i % 2 == 0 else (2 * c - 9 if 2 * c > 9 else 2 * c) for i, c in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pii(spark):
    texts = [
        "pay 4539578763621486 now", "again 4539 5787 6362 1486.", "acct 1234567890123456", "ip 97.51.17.173, no 999.1.1.1", "call +1 (017) 555-7713", "mail a.b-34@mail7.example.com!",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "born 1999-02-28 or 31.12.2001 not 1999-02-30", None, "", "plain 12 words", "GB82 1234 5698 7654 32", "ssn 123-45-6789",
    ]
    got = by_id(pii.pseudonymize(docs(spark, texts), KEY, found_col="found"))
    t = [got[i]["text"] for i in range(len(texts))]
    card = t[0].split()[1]
    assert card != "4539578763621486" and luhn(card) and t[1].split(" ", 1)[1].replace(" ", "").rstrip(".") == card
    assert t[2] == texts[2]
    m = re.fullmatch(r"ip (\d+)\.(\d+)\.(\d+)\.(\d+), no 999\.1\.1\.1", t[3])
    assert m and all(int(o) < 256 for o in m.groups()) and "97.51.17.173" not in t[3]
    assert re.fullmatch(r"call \+\d \(\d{3}\) \d{3}-\d{4}", t[4]) and t[4] != texts[4]
    assert re.fullmatch(r"mail [0-9a-f]+@example\.invalid!", t[5])
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', t[6]) and t[6] != texts[6]
    d = re.fullmatch(r"born (\S+) or (\d\d)\.(\d\d)\.(\d{4}) not 1999-02-30", t[7])
    assert d and datetime.date.fromisoformat(d[1]) and datetime.date(int(d[4]), int(d[3]), int(d[2]))
    assert t[8] is None and t[9] == "" and t[10] == texts[10]
    assert t[11] == texts[11] and re.fullmatch(r"ssn \d{3}-\d\d-\d{4}", t[12])
    assert got[0]["kind"] is None and got[0]["component"] == "x"


KEY = "a test key"


class PlainPii:
    """The same formats and permutations, one value at a time."""

    def keyed(self, tag, size, *parts):
        return int(hashlib.sha256("|".join([KEY, tag, *map(str, parts)]).encode()).hexdigest()[:15], 16) % size

    def number(self, x, a, b, tag):
        left, right = divmod(x, b)
        for i in range(1, 7):
            if i % 2:
                left = (left + self.keyed(tag, a, i, right)) % a
            else:
                right = (right + self.keyed(tag, b, i, left)) % b
        return left * b + right

    def digits(self, d, tag):
        out = []
        for at in range(0, len(d), 14):
            part, salt = d[at : at + 14], f"{len(d)}:{d[:at]}"
            n = len(part)
            a, b = 10 ** (n // 2), 10 ** (n - n // 2)
            left, right = int(part[: n // 2] or 0), int(part[n // 2 :])
            for i in range(1, 7):
                if i % 2:
                    left = (left + self.keyed(tag, a, n, salt, i, right)) % a
                else:
                    right = (right + self.keyed(tag, b, n, salt, i, left)) % b
            out.append((f"{left:0{n // 2}d}" if n > 1 else "") + f"{right:0{n - n // 2}d}")
        return "".join(out)

    def digest(self, tag, value, n):
        return "".join(hashlib.sha256(f"{KEY}|{tag}|{i}|{value}".encode()).hexdigest() for i in range(n // 64 + 1))[:n]

    def pour(self, shape, digits):
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in shape)

    def mod97(self, s):
        return int("".join(str(int(c, 36)) for c in s)) % 97

    def value(self, kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "secret":
            at = len(re.match(pii._NAMED, v)[0])
            return v[:at] + self.digest("secret", v[at:], len(v) - at)
        if kind == "email":
            return self.digest("email", v.lower(), max(12, v.index("@"))) + "@example.invalid"
        if kind == "date":
            iso = v[4] == "-"
            try:
                day = datetime.date(*((int(v[:4]), int(v[5:7]), int(v[8:])) if iso else (int(v[6:]), int(v[3:5]), int(v[:2]))))
            except ValueError:
                return v
            first = datetime.date(1900, 1, 1)
            x = (day - first).days
            if not 0 <= x < 73_049:
                return v
            x = self.number(x, 271, 272, "date")
            while x >= 73_049:
                x = self.number(x, 271, 272, "date")
            new = first + datetime.timedelta(x)
            return new.isoformat() if iso else f"{new.day:02}{v[2]}{new.month:02}{v[2]}{new.year:04}"
        if kind == "ip":
            o = [int(x) for x in v.split(".")]
            if max(o) > 255:
                return v
            x = self.number(int.from_bytes(bytes(o), "big"), 65536, 65536, "ip")
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "card":
            if not luhn(d):
                return v
            body = self.digits(d[:-1], "card")
            return self.pour(v, body + next(c for c in "0123456789" if luhn(body + c)))
        if kind == "iban":
            flat = v.replace(" ", "")
            if self.mod97(flat[4:] + flat[:4]) != 1:
                return v
            account = self.pour(flat[4:], self.digits(re.sub("[^0-9]", "", flat[4:]), "iban"))
            return self.pour(v, f"{98 - self.mod97(account + flat[:2] + '00'):02}" + re.sub("[^0-9]", "", account))
        return self.pour(v, self.digits(d, kind))

    def text(self, t):
        if t is None:
            return None
        whole = re.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items()), re.A)
        return whole.sub(lambda m: self.value(m.lastgroup, m[0]), t)


def with_luhn(body):
    return body + next(c for c in "0123456789" if luhn(body + c))


def test_pii_brute_force(spark):
    rng = random.Random(14)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    def iban():
        bank = rng.choice(["", "WEST", "AB1C"]) + num(rng.choice([8, 14, 16, 18]))
        return rng.choice("GDFN") + rng.choice("BERL"), bank
    def one():
        k = rng.randrange(13)
        if k == 12:
            c, b = iban()
            check = f"{98 - PlainPii().mod97(b + c + '00'):02}" if rng.random() < 0.7 else num(2)
            flat = c + check + b
            return flat if rng.random() < 0.5 else " ".join(flat[i : i + 4] for i in range(0, len(flat), 4))
        return [
            lambda: with_luhn(num(15)), lambda: num(16), lambda: with_luhn("37" + num(12)), lambda: with_luhn("4" + num(11)), lambda: f"{num(3)}-{num(2)}-{num(4)}", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)),
            lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", lambda: rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(num(3), num(3), num(4)), lambda: f"{rng.randrange(1890, 2110)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 32):02}",
            lambda: f"{rng.randrange(1, 32):02}{rng.choice('./')}{rng.randrange(1, 13):02}/{rng.randrange(1890, 2110)}".replace("/", rng.choice(["/", "."])), lambda: rng.choice(["a", "b.c-d", "x" * 80]) + "@" + rng.choice(["mail.example.com", "h.org", "-bad.com"]),
            lambda: rng.choice(["token = ", 'Key:"', "password=", "secret : "]) + rng.choice([num(20), "deadbeef" * 3, "Tr0ub4dor-and-3", "onlyletters", "x1" * 40]),
        ][k]()
    texts = [None, "", " ".join(f"4539578763621486 word{i}" for i in range(150)), "at 1.2.3.4", "KEY:deadbeefdeadbeef", "me@h.org", "secret=deadbeef", "a = b: c"]
    texts += [rng.choice(["", "see ", "é", "("]) + rng.choice([", ", " ", ".\n"]).join(one() for _ in range(rng.randrange(1, 5))) + rng.choice(["", ".", " end", ")"]) for _ in range(150)]
    df = docs(spark, [*texts, texts[5]], [*range(len(texts)), None]).repartition(3)
    got = pii.pseudonymize(df, KEY).collect()
    plain, seen = PlainPii(), collections.Counter()
    for r in got:
        want = plain.text(texts[5 if r["doc_id"] is None else r["doc_id"]])
        assert r["text"] == want
        seen[want != texts[5 if r["doc_id"] is None else r["doc_id"]]] += 1
    assert len(got) == len(texts) + 1 and seen[True] > 80
    assert pii.pseudonymize(docs(spark, []), KEY).count() == 0
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymize(df, "")


def test_pii_values_stay_linked(spark):
    c = with_luhn("453957876362148")
    got = by_id(pii.pseudonymize(docs(spark, [c, f"x {c[:4]} {c[4:8]} {c[8:12]} {c[12:]} y", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "37" + c]), KEY, found_col="found"))
    t = [got[i]["text"] for i in range(5)]
    assert t[1].removeprefix("x ").removesuffix(" y").replace(" ", "") == t[0] != c and luhn(t[0])
    assert t[2].replace(" ", "") == t[3] and re.fullmatch(r"GB\d\d WEST( \d{4}){3} \d\d", t[2]) and PlainPii().mod97(t[3][4:] + t[3][:4]) == 1
    assert [f["kind"] for f in got[2]["found"]] == ["iban"] and got[4]["found"] == []


def test_pii_long_secrets(spark):
    sizes = (128, 129, 160, 5000)
    values = ["0123456789abcdef" * (n // 16) + "a" * (n % 16) for n in sizes]
    got = by_id(pii.pseudonymize(docs(spark, [f"token = {v} end" for v in values]), KEY))
    for i, (n, value) in enumerate(zip(sizes, values, strict=True)):
        assert re.fullmatch(rf"token = [0-9a-f]{{{n}}} end", got[i]["text"]) and value[-64:] not in got[i]["text"]


def test_feistel_is_a_permutation(spark):
    n = spark.range(1000)
    three = n.select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("v"))
    assert three.distinct().count() == 1000 and three.where("length(v) <> 3").count() == 0
    walked = n.select(pii.walk_number(F.col("id"), 32, 32, 1000, "k", "t").alias("v"))
    assert {r[0] for r in walked.collect()} == set(range(1000))
    long = spark.range(300).select(pii.permute_digits(F.concat(F.lit("12345678901234"), F.lpad(F.col("id").cast("string"), 4, "0")), "k", "t").alias("v"))
    assert long.distinct().count() == 300 and long.where("length(v) <> 18").count() == 0


# ------------------------------------------------------------------ 7 benchmark


def test_decontamination_of_odd_ids(spark):
    item = " ".join(f"v{k}" for k in range(20))
    bench = spark.createDataFrame([(4, item), (4, item), (None, item)], "item_id long, text string")
    got = decontam.find_leaks(spark, docs(spark, [item, item, "x " + item, "other words", item], [1, 1, 2, 2, None]), bench)
    assert collections.Counter((r["doc_id"], r["item_id"], r["first_word"]) for r in got.collect()) == {(1, 4, 0): 4, (2, 4, 1): 2}
    for bad in (lambda: decontam.find_leaks(spark, docs(spark, []).withColumn("doc_id", F.lit("x")), bench), lambda: decontam.find_leaks(spark, docs(spark, []), bench.withColumn("item_id", F.lit("x")))):
        with pytest.raises(TypeError, match="integers"):
            bad()


def test_walk_reads_windows_to_the_end():
    # two windows that differ in the last words alone differ in the last places read
    index = decontam.Index([0], [" ".join(f"v{k}" for k in range(60))], 0.8, 400, 1)
    words = np.arange(1, 61).astype(np.uint64)
    other = words.copy()
    other[-3:] += np.uint64(500)
    keys = index.keys(np.concatenate((words, other)), np.array([0, 60]), np.array([60, 60]))
    assert 0 < (keys[0] != keys[1]).sum() < 100


def test_decontamination(spark):
    rng = random.Random(8)
    items = [" ".join(f"v{rng.randrange(5000)}" for _ in range(rng.randrange(14, 60))) for _ in range(40)]
    lead = lambda: " ".join(f"u{rng.randrange(5000)}" for _ in range(30))
    texts, want = [], {}
    for i, t in enumerate(items):
        texts.append(f"{lead()} {t.upper()}%%% {lead()}")
        want[len(texts) - 1] = i
        w = t.split()
        for _ in range(len(w) // 10):
            w[rng.randrange(len(w))] = "zz"
        texts.append(f"{' '.join(w)}\n{lead()}")
        want[len(texts) - 1] = i
        half = t.split()
        texts.append(f"{lead()} {' '.join(half[: len(half) // 2])} {lead()}")
    texts += ODD + [lead()]
    bench = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, "")], "item_id long, text string")
    got = decontam.find_leaks(spark, docs(spark, texts), bench).collect()
    assert {r["doc_id"]: r["item_id"] for r in got} == want
    assert all(r["edits"] <= 0.2 * r["item_words"] for r in got)
    assert decontam.find_leaks(spark, docs(spark, texts), bench.limit(0)).count() == 0
    assert decontam.find_leaks(spark, docs(spark, []), bench).count() == 0


def test_windows_lose_no_edited_passage():
    rng = random.Random(9)
    items = [[f"v{rng.randrange(800)}" for _ in range(rng.randrange(5, 50))] for _ in range(30)]
    index = decontam.Index(list(range(30)), [" ".join(w) for w in items], 0.8, 48, 4)
    hit = total = 0
    for i, w in enumerate(items):
        k = decontam.allowed_edits(len(w), 0.8)
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randrange(k + 1)):
                v[rng.randrange(len(v))] = f"new{rng.randrange(99)}"
            total += 1
            hit += any(m[1] == i for m in index.search([" ".join(["p"] * 20 + v + ["s"] * 20)]))
    assert hit / total >= 0.95


def edited(words, edits, how, rng):
    w = list(words)
    for n, at in enumerate(sorted(rng.sample(range(len(w)), edits), reverse=True)):
        one = how if how != "mixed" else ("swap", "add", "drop")[n % 3]
        w[at : at + (one != "add")] = [] if one == "drop" else [f"new{rng.randrange(10**6)}"]
    return w


def test_long_passages_at_the_largest_distance():
    rng = random.Random(21)
    items = [[f"v{rng.randrange(3000)}" for _ in range(n)] for n in (5, 16, 40, 60, 100, 200) for _ in range(3)] + [["so", "on"] * 20, ["x"] * 30]
    index = decontam.Index(list(range(len(items))), [" ".join(w) for w in items], 0.8, 48, 4)
    texts = []
    for w in items:
        k = decontam.allowed_edits(len(w), 0.8)
        for how in ("swap", "add", "drop", "mixed"):
            for edits in (k, k + 1):
                texts.append(" ".join([f"p{rng.randrange(99)}" for _ in range(9)] + edited(w, edits, how, rng) + ["s"] * 9 + edited(w, k, how, rng)))
    texts += [" ".join(["x"] * 500), "so on " * 90, "v1 v2 " * 40]
    want = []
    for t, text in enumerate(texts):
        words = decontam.words_of([text])[0]
        for i, (_, w) in enumerate(index.items):
            d, end = decontam.fit_distance(w, words)
            if d <= decontam.allowed_edits(len(w), 0.8):
                want.append((t, i, d, max(end - len(w), 0)))
    assert len(want) >= 8 * 18 and index.search(texts) == want


# ------------------------------------------------------------------ 8 substrings


def plain_dedup(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("common_gram", [64, 1])
def test_substrings_brute_force(spark, monkeypatch, common_gram):
    monkeypatch.setattr(suffix_dedup, "COMMON_GRAM", common_gram)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeéf") for _ in range(rng.randrange(1, 9)))
    passage = " ".join(word() for _ in range(40))
    texts = [None, "", "x" * 99, "x" * 350, "ab" * 200]
    for _ in range(40):
        t = " ".join(word() for _ in range(rng.randrange(5, 120)))
        if rng.random() < 0.6:
            at, a = rng.randrange(len(t)), rng.randrange(len(passage) // 2)
            t = t[:at] + passage[a : a + rng.randrange(60, 260)] + t[at:]
        texts.append(t)
    texts += [texts[10], texts[11], texts[10][5:]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = by_id(suffix_dedup.dedup(spark, docs(spark, texts, ids).repartition(4), 100))
    want = plain_dedup(list(zip(ids, texts, strict=True)), 100)
    for d, w in want.items():
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == w
        assert hashlib.sha256(got[d]["kept"]).hexdigest() == w[3]
    assert suffix_dedup.dedup(spark, docs(spark, [])).count() == 0


def test_substrings_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 500)
    rng = random.Random(16)
    passage = "".join(rng.choice("abcd ") for _ in range(400))
    texts = [passage[rng.randrange(200) :] + "".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(60)]
    texts[7] = "long words " * 20_000
    got = by_id(suffix_dedup.dedup(spark, docs(spark, texts).repartition(5), 100))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == plain_dedup(list(enumerate(texts)), 100)


def test_substrings_of_odd_ids(spark):
    rng = random.Random(17)
    t, u, v = ("".join(rng.choice("abcdefgh ") for _ in range(230)) for _ in range(3))
    got = suffix_dedup.dedup(spark, docs(spark, [t, t, u, u + v, v, t, None], [5, 5, 5, 2, None, 9, 5]).repartition(3), 100)
    rows = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got.collect())
    # equal rows keep what they hold; another text under the same id is judged by its own places
    assert rows == {(5, 230, 0): 2, (5, 230, 230): 1, (2, 460, 0): 1, (None, 230, 0): 1, (9, 230, 230): 1, (5, 0, 0): 1}
    with pytest.raises(TypeError, match="integers"):
        suffix_dedup.dedup(spark, docs(spark, [t]).withColumn("doc_id", F.lit("x")))


def test_too_long_substrings_raise(spark):
    with pytest.raises(ValueError, match="at most 279"):
        suffix_dedup.dedup(spark, docs(spark, ["a"]), length=280)


def test_buckets_of_sorted_rows():
    rng = np.random.default_rng(2)
    rows = sorted(map(tuple, rng.integers(0, 5, (400, 3)).tolist()))
    splitters = sorted(set(map(tuple, rng.integers(0, 5, (40, 3)).tolist())))
    got = suffix_dedup._buckets([np.array(c) for c in zip(*rows, strict=True)], splitters)
    assert got.tolist() == [sum(s <= r for s in splitters) for r in rows]
    assert suffix_dedup._buckets([np.array([1, 2])] * 3, []).tolist() == [0, 0]


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    cols = [rng.integers(0, 4, 9000), rng.integers(0, 50, 9000), rng.integers(0, 9, 9000)]
    order = suffix_dedup.multikey_quicksort(cols, 64)
    rows = list(zip(*(c[order].tolist() for c in cols), strict=True))
    assert rows == sorted(rows) and len(set(order.tolist())) == 9000


# ------------------------------------------------------------------ 9 toxicity


def labelled(spark, n=900):
    rng = random.Random(7)
    vocab = [f"{a}{b}" for a in ("la", "mo", "ti", "re", "su") for b in ("ka", "ne", "po", "vi", "zu", "ro")]
    texts, marks = [], []
    for _ in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 80))]
        y = rng.random() < 0.3
        if y:
            w[rng.randrange(len(w))] = "vile" + rng.choice(["", "s", "ness", "ly"])
        texts.append(" ".join(w))
        marks.append(int(y))
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(marks)], "doc_id long, quality int, toxic int")
    return texts, marks, labels


def test_toxicity_held_out(spark):
    texts, marks, labels = labelled(spark)
    got = by_id(toxicity.classify(spark, docs(spark, texts + ODD), labels))
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    right = np.mean([got[i]["predicted"] == marks[i] for i in held])
    assert right >= 0.95 and all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(texts) + len(ODD)
    model = toxicity.learn(spark, docs(spark, texts), labels)
    kept = toxicity.keep_clean(docs(spark, texts), model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(len(texts)) if not got[i]["predicted"]}
    assert kept.columns == docs(spark, []).columns


def test_toxicity_of_odd_rows(spark):
    texts, marks, labels = labelled(spark, 600)
    twice = labels.union(labels.limit(40).withColumn("toxic", 1 - F.col("toxic")))
    ids = list(range(len(texts))) + [None, 2**60 + 1, 2**60 + 1, 3]
    more = texts + [texts[0], texts[1], texts[1], texts[2]]
    model = toxicity.learn(spark, docs(spark, more, ids), twice)
    assert model.trained
    got = toxicity.score(docs(spark, more, ids).repartition(1), model).collect()
    score = collections.defaultdict(set)
    for r in got:
        score[r["doc_id"]].add(r["score"])
    assert len(got) == len(ids) and score[None] == score[0] and score[2**60 + 1] == score[1] and score[3] > score[2]
    kept = toxicity.keep_clean(docs(spark, more, ids).repartition(1), model)
    assert all(r["n_chars"] is None and r["doc_id"] in score for r in kept.collect())


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.classify(spark, docs(spark, ["a", None]), none).collect()
    assert [(r["score"], r["predicted"]) for r in got] == [(0.0, 0)] * 2
    assert toxicity.classify(spark, docs(spark, []), none).count() == 0


# ------------------------------------------------------------------ 10 language


def test_gradients_by_difference():
    rng = np.random.default_rng(0)
    net = langid.Direction.fresh(rng)
    steps = rng.integers(1, 255, (6, 3)).astype(np.intp)
    states, kept = net.run(steps, keep=True)
    weight = rng.normal(size=states.shape).astype(np.float32)
    grads = net.back(steps, kept, weight)
    for p, g in zip(net.params(), grads, strict=True):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(4)] + [(1, int(steps[2, 1])) if p.shape[1] == 256 else (1, 0)]:
            old = p[at]
            p[at] = old + 1e-2
            up = float((net.run(steps) * weight).sum())
            p[at] = old - 1e-2
            down = float((net.run(steps) * weight).sum())
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-2, abs=2e-2, rel=5e-2)


def test_language_held_out(spark):
    rng = random.Random(3)
    kinds = {"en": ["the", "and", "which", "shop", "with"], "fr": ["été", "une", "où", "chez", "voilà"], "de": ["über", "und", "groß", "nicht", "schön"]}
    rows = []
    for i in range(450):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, " ".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(6, 60))), lang, None, None))
    n = len(rows)
    rows += [(n + k, t, None, None, None) for k, t in enumerate([None, "", "123 456 !!!", "the and " * 3000])]
    df = spark.createDataFrame(rows, DOC).withColumn("score", F.lit("clash"))
    got = by_id(langid.identify(spark, df))
    held = [i for i in range(n) if got[i]["held_out"]]
    assert held and np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) >= 0.97
    assert [got[n + k]["lang_pred"] for k in range(4)] == ["und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = spark.createDataFrame([(None, "the and which", "en", None, None), (2**60 + 1, "été où", "fr", None, None), (2**60 + 1, "été où", "fr", None, None)], DOC)
    again = langid.predict(odd.repartition(1), langid.learn(df)).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in again) == [(0, "en"), (2**60 + 1, "fr"), (2**60 + 1, "fr")]
    nothing = langid.identify(spark, df.where("lang is null"))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_every_language_is_learned(spark, monkeypatch):
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèçñøåłśžčěđ"
    words = [["".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(8)] for _ in range(70)]
    rows = [(i, " ".join(rng.choice(words[i % 70]) for _ in range(40)), f"l{i % 70:02}", None, None) for i in range(70 * 25)]
    df = spark.createDataFrame(rows, DOC)
    got = by_id(langid.identify(spark, df))
    held = [i for i in got if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) >= 0.9
    assert {r["lang_pred"] for r in got.values()} == {r[2] for r in rows}
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 69)
    with pytest.raises(ValueError, match="too many"):
        langid.learn(df)


# ------------------------------------------------------------------ pipeline


def test_pipeline_by_stage(spark, tmp_path):
    import corpus_pipeline

    texts, marks, labels = labelled(spark, 500)
    rng = random.Random(2)
    long = " ".join(f"unique{rng.randrange(10**6)}" for _ in range(80))
    item = " ".join(f"bench{k}" for k in range(30))
    extra = [long, long.replace("unique", "Unique", 1), "start " + item + " end", "call +1 (017) 555-7713 about it", "", None]
    rows = docs(spark, texts + extra).select("doc_id", "text", "lang", "source", "n_chars")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    cur = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, cur, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        cur = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = by_id(cur)
    n = len(texts)
    assert np.mean([(i in seen["toxicity"]) == (not marks[i]) for i in range(n)]) >= 0.97
    left = sorted(seen["toxicity"])
    groups = plain_join([seen["toxicity"][i]["text"] for i in left], 80, 5)
    assert set(seen["ngram_join"]) == {left[k] for k, (_, c) in enumerate(groups) if c == k}
    assert set(seen["ngram_join"]) - set(seen["decontamination"]) == {n + 2}
    assert set(seen["pii"]) == set(seen["decontamination"]) == set(seen["bpe"])
    assert "555-7713" not in seen["pii"][n + 3]["text"] and seen["pii"][n + 3]["n_chars"] == len(seen["pii"][n + 3]["text"])
    got = by_id(corpus_pipeline.run(spark, str(tmp_path)))
    assert {k: r["ids_sha256"] for k, r in got.items()} == {k: r["ids_sha256"] for k, r in seen["bpe"].items()}


def test_html_entities_once():
    assert html_extract.blocks_of("<article><p>&amp;lt; &#233;</p></article>")[0].text == html.unescape("&amp;lt; é")
