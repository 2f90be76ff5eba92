"""Conversation repair, SentencePiece and whitening against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusframe.llm import conversation, piece_bpe, queries, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

# ------------------------------------------------------------------ 11 conversations

ROWS = "conv_id long, turn long, role string, text string"


def plain_repair(rows):
    """The cheapest edits by trying all, rows as (role, text, fault)."""
    best = None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = []
    for role, text, fault in rows:
        late = 1 if fault == "truncated" else 0
        own = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            own += [("K", late, f"{role}:{text}"), ("R", 2 + late, f"user:{text}"), ("R", 2 + late, f"assistant:{text}")]
        choices.append([("I" * len(put) + letter, 2 * len(put) + cost, [f"{p}:" for p in put] + ([line] if line else [])) for put in inserts for letter, cost, line in own])
    choices.append([("I" * len(put), 2 * len(put), [f"{p}:" for p in put]) for put in inserts])
    for picked in itertools.product(*choices):
        lines = [line for _, _, some in picked for line in some]
        if re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines)):
            found = sum(c for _, c, _ in picked), "".join(a for a, _, _ in picked), "\n".join(lines)
            best = found if best is None else min(best, found)
    return best


def plain_faults(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def test_trie_gives_the_cheapest_edits_and_the_least_audit():
    rng = random.Random(3)
    cases = []
    for _ in range(150):
        n = rng.randrange(4)
        cases.append([(rng.choice(["system", "user", "assistant", "tool", "user"]), f"t{i}", rng.choice(["", "", "truncated", "blank", "duplicate"])) for i in range(n)])
    sign = lambda role, fault: "x" if fault in ("blank", "duplicate") else (s.upper() if fault else s) if (s := role[0] if role[0] in "sua" else "o") else ""
    signed = sorted(("".join(sign(r, f) for r, _, f in rows), i) for i, rows in enumerate(cases))
    trie = conversation.RepairTrie()
    for signature, i in signed:
        cost, edits = trie.repair(signature)
        want = plain_repair(cases[i])
        assert (cost, "".join(edits)) == want[:2], (cases[i], edits, want)
    prefixes = {s[:k] for s, _ in signed for k in range(1, len(s) + 1)}
    assert trie.layers_made == len(prefixes)  # once for each edge of the trie


def conversations(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "Well", " ", "", "\t\n", "a. b", None, "Yes.", "é. ", "x?\x0b", "no "]
    rows = [(rng.choice([*range(60), None]), rng.choice([*range(5), None, 9]), rng.choice(["user", "assistant", "system", "tool", None, "", "User", "sudo"]), rng.choice(texts)) for _ in range(320)]
    # one after the other
    rows += [(100 + c, t, ("user", "assistant")[t % 2], f"Text {c} {t}.") for c in range(40) for t in range(4)] + [(7, 1, "user", "Yes.")] * 3
    return rows


def test_conversations_match_a_plain_version_and_the_sql(spark):
    rows = conversations(spark)
    df = spark.createDataFrame(rows, ROWS).withColumn("conv", F.lit("clash")).withColumn("place", F.lit(1)).repartition(5)
    got = {r["conv_id"]: r for r in conversation.repair(spark, df, damage=True).collect()}
    assert set(got) == {r[0] for r in rows}
    kept = {c: [] for c in got}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept[conv] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        told = plain_faults([r[1:] for r in own])
        turns = [r[0] for r in own if r[0] is not None]
        r = got[conv]
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        for fault in ("blank", "duplicate", "truncated"):
            assert r[fault] == sum(f == fault for _, _, f in told)
        assert r["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
        if len(told) < 4:
            cost, audit, text = plain_repair(told)
            assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = {r[0]: r for r in con.sql(queries.ORACLES["op11_conversation"]).project(", ".join(names)).fetchall()}
    assert {c: tuple(r[n] for n in names) for c, r in got.items()} == want


def test_conversations_long_and_empty(spark, monkeypatch):
    assert conversation.repair(spark, spark.createDataFrame([], ROWS), damage=True).count() == 0
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"No {t}{rng.choice(['.', ''])}") for t in range(2600)] + [(2, t, ("user", "assistant")[t % 2], "word " * 20000 + f"{t}.") for t in range(2)]
    got = {r["conv_id"]: r for r in conversation.repair(spark, spark.createDataFrame(rows, ROWS)).collect()}
    assert got[2]["audit"] == "KK" and got[2]["cost"] == 0
    assert got[2]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows if r[0] == 2).encode()).hexdigest()
    # pieces of any size give the same
    monkeypatch.setattr(conversation, "PIECE", 7)
    small = {r["conv_id"]: r for r in conversation.repair(spark, spark.createDataFrame(rows, ROWS)).collect()}
    assert small == got and len(re.sub("I", "", got[1]["audit"])) == 2600


# ------------------------------------------------------------------ 12 SentencePiece

PARTS = [" ", "  ", "   ", "\n", "\t", "a", "don't", "▁", "▁▁", "q", "Z", "é", "à", " ", "中", "😀", "12", "%%%", "\r\n", "THe", "<s>", "</s>", "<0x0A>", "<unk>", "\x00", "é", "벨", "hello world", "�"]
TEXTS = [None, "", " ", "a", " a", "a ", "▁", "x" * 20000, "word " * 4000, " " * 1000, "中" * 3000, "é" * 500]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_match_the_library(spark):
    sp, rng = library(), random.Random(1)
    texts = TEXTS + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(1500)]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts, 1)] + [(7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = piece_bpe.encode_decode(df, PIECES).collect()
    assert len(got) == len(rows) and sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _ in rows)
    by = {(r["doc_id"], r["ids_sha256"]): r for r in got}
    for i, t in rows:
        ids = sp.encode(t or "")
        r = by[i, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert piece_bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


def test_spans_are_those_of_the_library():
    sp, m, rng = library(), piece_bpe.PieceBPE(PIECES), random.Random(2)
    for t in [*TEXTS[1:], *("".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(500))]:
        _, starts, ends = m.encode(t)
        assert [(p.begin, p.end) for p in sp.encode(t, return_type="proto").pieces] == list(zip(starts.tolist(), ends.tolist(), strict=True))
        raw = t.encode()
        assert b"".join(raw[a:b] for a, b in zip(starts, ends, strict=True)) == raw  # every byte once


def test_merges_alike_with_and_without_the_fast_merger():
    m, rng = piece_bpe.PieceBPE(PIECES), random.Random(4)
    plain = piece_bpe.PieceBPE(PIECES)
    plain.fast = None
    for _ in range(2000):
        word = "▁" * rng.randrange(2) + "".join(rng.choice("abcdeéstü中\n1") for _ in range(rng.randrange(1, 14)))
        assert m._packed(word) == plain._packed(word)
    long = "".join(rng.choice("abcdest") for _ in range(3000))
    assert plain._merged_long(list(long[:150])) == plain._merged(long[:150])
    assert plain._merged(long) == plain._merged_long(list(long))


def test_decoding_of_any_ids():
    sp, m, rng = library(), piece_bpe.PieceBPE(PIECES), random.Random(6)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3), rng.randrange(3, 259), rng.randrange(195, 259), 29871, 259, 231, 187, 176]) for _ in range(rng.randrange(12))]
        assert m.decode(ids) == sp.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("extra", [{}, {"add_dummy_prefix": True, "escape_whitespaces": True, "remove_extra_whitespaces": True}])
def test_compiled_maps_and_offsets(rule, extra):
    sentencepiece = pytest.importorskip("sentencepiece")
    library, rng = sentencepiece.SentencePieceNormalizer(rule_name=rule, **extra), random.Random(9)
    mine = piece_bpe.Normalizer(next(v for k, v in piece_bpe.records(library.serialized_model_proto()) if k == 3))
    for _ in range(500):
        t = "".join(rng.choice([*PARTS, "ﬁ", "①", "㌔", "Å", "ABC", "Ａ", "　"]) for _ in range(rng.randrange(15)))
        want, offsets = library.normalize(t, with_offsets=True)
        got, places = mine(t)
        raw, own = t.encode(), got.encode()
        char = np.cumsum([b & 0xC0 != 0x80 for b in raw] + [True]) - 1
        starts = [i for i, b in enumerate(own) if b & 0xC0 != 0x80] + [len(own)]
        assert got == want and [int(char[places[i]]) for i in starts] == list(offsets)


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"")
    with pytest.raises(ValueError):
        piece_bpe.PieceBPE(str(tmp_path / "m"))


# ------------------------------------------------------------------ 13 whitening

VEC = "vec_id long, embedding array<double>, label int"


def plain_whitening(vectors, k=4):
    x = np.floor(256 * np.array(vectors)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(1)
    # a far mean against a small spread, one large direction, and repeated rows
    v = rng.normal(size=(300, 6)) * [3, 1, 0.5, 0.2, 0.1, 0.05] + [1e5, -1e5, 7, 0, 0, 1]
    v[200:] = v[0]
    rows = [(i, list(map(float, r)), None) for i, r in enumerate(v)]
    bad = [(900, None, 1), (901, [float("nan")] * 6, 1), (902, [None] + [1.0] * 5, 1), (903, [float("inf")] + [0.0] * 5, 1), (904, [], 1), (905, [1.0], 1)]
    df = spark.createDataFrame(rows + bad + [(None, rows[3][1], 2)], VEC).withColumn("x", F.lit(1)).withColumn("n", F.lit(0)).repartition(3)
    got = whitening.whiten(spark, df).toPandas()
    n, deviation, z, explained = plain_whitening(v)
    assert len(got) == 301 * 4 and set(got["n"]) == {n} and n == 200
    own = got[got["vec_id"].notna()].sort_values(["vec_id", "component"])
    assert own["deviation"].tolist() == np.repeat(deviation, 4).tolist()
    mine = own["whitened"].to_numpy().reshape(-1, 4)
    sign = np.sign((mine * z).sum(axis=0))
    np.testing.assert_allclose(mine, z * sign, rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose(own["explained"].to_numpy().reshape(-1, 4)[0], explained, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-8


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(spark, spark.createDataFrame([], VEC)).count() == 0
    assert whitening.whiten(spark, spark.createDataFrame([(1, None, 1)], VEC)).count() == 0
    one = whitening.whiten(spark, spark.createDataFrame([(1, [0.5, -0.001], 1)] * 2, VEC)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)] * 2
    flat = whitening.whiten(spark, spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 1) for i in range(5)], VEC)).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True, 3: True} and flat[0]["identity_error"] < 1e-12
    # exact beyond 53 bits, null beyond long
    far = [(i, [float(i * 1e3), 1e3 * (i % 7)], 1) for i in range(60)]
    n, deviation, _, _ = plain_whitening([r[1] for r in far], 2)
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark, spark.createDataFrame(far, VEC)).collect()} == dict(enumerate(deviation.tolist()))
    huge = whitening.whiten(spark, spark.createDataFrame([(1, [1e300], 1), (2, [-1e300], 1)], VEC)).collect()
    assert [(r["deviation"], round(abs(r["whitened"]), 9)) for r in huge] == [(None, 1.0)] * 2


# ------------------------------------------------------------------ earlier operators at their bounds


def test_pii_hosts_of_many_labels(spark):
    texts = ["x@" + "a." * n + "com" for n in (1, 3, 5_000, 200_000)]
    odd = ["a@b.com.x1", "a@b.x1", "a@-b.com", "a@b-.com", "a@b..com", "a@b.c.dd.e", "a@b.co,", "q a@b.c1.de.f2.gh-x end"]
    df = spark.createDataFrame(list(enumerate(texts + odd)), "doc_id long, text string")
    got = {r["doc_id"]: r["found"] for r in queries.pii.pseudonymize(df, "k", found_col="found").collect()}
    for i, t in enumerate(texts):
        assert [f["value"] for f in got[i]] == [t]
    # what a pattern that may go back over its labels finds
    plain = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}")
    for i, t in enumerate(odd, len(texts)):
        assert [f["value"] for f in got[i]] == plain.findall(t), t


def test_pii_key_fallback_is_announced(spark):
    with pytest.warns(UserWarning, match="public key"):
        queries.pii_key(spark)


def test_tiny_and_large_vectors_link_by_direction(spark):
    rows = [(i, [float(i), 1.0], 1) for i in range(9)] + [(20, [1e-300, 0.0], 1), (21, [3e-320, 0.0], 1), (22, [1e200, 0.0], 1)]
    got = {r["vec_id"]: r for r in queries.embed_dedup.near_duplicates(spark, spark.createDataFrame(rows, VEC)).collect()}
    assert [got[i]["component_id"] for i in (20, 21, 22)] == [min(i for i in got if got[i]["component_id"] == got[20]["component_id"])] * 3
    assert got[20]["n_links"] >= 2


def text_of(page):
    return "\n\n".join(b.text for b in queries.html_extract.blocks_of(page) if b.main and not b.skipped)


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p class="share-price">Up 3 %.</p><div class="social-science">Study.</div><section class="search">Found.</section></article>', "Up 3 %.\n\nStudy.\n\nFound."),
        ('<article><p>One.</p><div class="ad-banner">Buy</div><ul class="site-nav"><li>Home</ul><div id="cookie-notice">Yes</div><div class="comments-list"><p>me too</p></div><p>Two.</p></article>', "One.\n\nTwo."),
        ("<article><p>Press <button>OK</button> to go, <label>not</label>where <math>x</math> is.</p></article>", "Press to go, where is."),
        ('<article><p>A <span class="ad">Buy <b>now</b></span> B<p>C <select><option>1<option>2</select>D</article>', "A B\n\nC D"),
        ("<nav><ul><li>Home<article><p>Text.</p></article>", "Text."),
        ("<aside><article><p>Other.</p></article></aside><main><p>Own.</p></main>", "Own."),
        ("<header><h1>Site</h1><article><header>Title line</header><p>Text.</p></article>", "Text."),
        ("<article><p>Text.</p></article><p class='x" + "y" * 1000, "Text."),
        ("<article><p>1 < 2 and a<b>c</b> &lt;x&gt;</p><p>end <a href=", "1 < 2 and ac <x>\n\nend"),
        ("<article><p>A <span class='ad'>Buy<p>B</article>", "A\n\nB"),
        ("<article><label><p>In</p></label><p>Out</p></article>", "Out"),
    ],
)
def test_main_text_of_written_pages(page, want):
    assert text_of(page) == want


def test_url_rules_beyond_the_literal_list(spark, monkeypatch):
    urls = ["http://a.com/casino-x", "https://b.org/ok", None, "http://ads.net/es/1", "http://x.org/wp-admin/", "nothing", "http://porn.example.com/en/a?b", "HTTP://C.ORG/track/click/9"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = []
    for most in (queries.url_filter.MOST_LITERAL, 0):
        monkeypatch.setattr(queries.url_filter, "MOST_LITERAL", most)
        found.append(sorted(map(str, queries.url_filter.judge(df).collect())))
    assert found[0] == found[1] and len(found[0]) == len(urls)


def test_pipeline_stages_with_odd_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, same, other = prose(60), prose(80), prose(70)
    rows = [
        (1, same), (2, same + " end"), (None, same), (3, None), (None, None), (4, ""), (5, prose(30) + " " + passage + " " + prose(30)), (None, "x " + passage),
        (6, other + " mail a@b.com"), (6, prose(40)), (7, prose(50)), (7, prose(50)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(7, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    empty = docs.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        none = stage(spark, empty, str(tmp_path))
        assert none.count() == 0 and none.columns == made.columns
        if name == "bpe":
            assert made.count() == docs.count()
            continue
        assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / name))
        docs, empty = spark.read.parquet(str(tmp_path / name)), none
        ids = sorted(str(r["doc_id"]) for r in docs.collect())
        if name == "toxicity":
            assert len(ids) == len(rows)
        if name == "ngram_join":  # 2 is a copy of 1; rows without an id are not named
            assert ids == sorted(str(i) for i, _ in rows if i != 2)
        if name == "decontamination":  # 5 holds the passage; so does a row without an id, which stays
            assert ids == sorted(str(i) for i, _ in rows if i not in (2, 5))
        if name == "pii":
            texts = [r["text"] for r in docs.collect()]
            assert not any("a@b.com" in t for t in texts if t) and texts.count(None) == 2
