"""HTML extraction: page structure, and a suffix array over each host's pages.

A page is read into blocks of text.  Elements that are never main text (menus,
headers, footers, side bars, notices, adverts, forms, scripts, styles, reader
comments) mark their blocks by element name, role or class.  What is left of an
``article`` or ``main`` element is the main text.

Blocks outside such an element are decided by the host: the runs of
``LEAST_RUN`` tokens (words, with a mark for each block's element) of its pages
are the starts of the host's suffixes, sorted as far as they are compared.  Runs
that occur on distinct pages are boilerplate and are cut out of their blocks;
the words between them are kept, whether or not the page has an article.  Where
a run reaches into a block by fewer tokens, it is cut there only if it covers
the block.  Runs are compared by 64-bit hashes with that of their host.

Repetition alone does not remove text inside an article: a host may carry the
same article, or the same paragraph, on several pages, and it is still the
article of each.

The whole host counts, however pages are dealt out: one narrow pass writes each
page's distinct runs, which are grouped over all pages (combined in each task
first), and the repeated ones are joined back to the pages that hold them in a
block that they can change.  Equal rows are one page, so they do not repeat each
other.

Defined results: null or empty html gives an empty text; a null url has an
empty host; pages of that host are treated as one host's.  Unclosed elements
end with their container; a quotation mark belongs to a tag's value only right
after an equals sign; pages of any length are read whole; ids pass through, be they
null, repeated or strings.  A skipped element inside a line is left out of its block and
does not part it; a tag that never ends is dropped to the end of the page; a class
or id is a mark only as a whole name.  Repeated rows
give repeated results; other columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, materialize, mix64, word_hashes
from .url_filter import host_path

LEAST_RUN = 8

# fixed values: element names by what they do
SKIPPED = frozenset("head script style noscript template svg math canvas object embed audio video form button select option textarea input label fieldset iframe nav header footer aside dialog menu".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
MAIN = frozenset(("article", "main"))
SIBLINGS = {
    "p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}
CONTAINERS = BLOCK - frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 hr caption legend summary figcaption".split())
# fixed values: words of a class, id or role that mark boilerplate
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars footer masthead comment comments commentlist disqus respond share sharing social related newsletter subscribe popup modal overlay pagination pager toolbar login signup widget complementary contentinfo".split()
)
# fixed values: words that may stand beside a mark in a name of several words
BESIDE = frozenset(
    "site page main top bottom left right head body primary secondary global local fixed sticky inline mobile desktop post article content section wrapper wrap container box block bar area panel list item items link links inner outer group row col column button buttons icon icons form zone unit slot label text title header center middle small large wide first last".split()
)
NEVER_BY_CLASS = frozenset(("html", "body", "article", "main"))

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+)*+)>""", re.S)
_BROKEN = re.compile(r"<[/!?A-Za-z]")
#: Skipped blocks that an article or main element ends if they are never closed.
UNCLOSED = ("nav", "header", "footer", "aside", "form", "menu")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def marked(attrs: str) -> tuple[bool, bool]:
    """(boilerplate, main) by the attributes of an element."""
    if not attrs:
        return False, False
    main = False
    for m in _ATTR.finditer(attrs):
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            words = [w for w in re.split(r"[-_]+", token) if w]
            role = m[1].lower() == "role"
            if role and token in MAIN:
                main = True
            # a name is a mark as a whole: each of its words is one, or may stand by one
            if role and token == "search" or any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE or w.isdigit() for w in words):
                return True, False
    return bool(_HIDDEN.search(attrs)), main


@dataclass
class Block:
    text: str
    element: str
    skipped: bool
    main: bool


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, skipped, main, never closed
    parts: list[str] = []
    element = "body"
    inside = 0  # open skipped elements that are no blocks
    open_for_ever = unclosed(page or "")

    def say(piece: str) -> None:
        # what a skipped element inside a line holds is no part of the line's block
        if not inside:
            parts.append(piece)

    def leave(i: int) -> None:
        """Close the elements from the i-th on."""
        nonlocal inside
        inside -= sum(e[0] not in BLOCK for e in stack[i:])
        del stack[i:]

    def close_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                skipped, main = next(((e[1], e[2]) for e in reversed(stack) if e[0] in BLOCK), (False, False))
                out.append(Block(text, element, skipped, main))

    at, text = 0, page or ""
    while True:
        m = _TAG.search(text, at)
        if m is None:
            # a tag that never ends is dropped to the end of the page
            rest = text[at:]
            broken = _BROKEN.search(rest)
            say(rest[: broken.start()] if broken else rest)
            break
        if m.start() > at:
            say(text[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            say(" ")
            continue
        if m[1]:
            if name in BLOCK:
                close_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(e[0] in BLOCK for e in stack[i:]):
                        close_block()
                    leave(i)
                    break
                if stack[i][0] in CONTAINERS and name not in CONTAINERS:
                    break
            continue
        if name in BLOCK:
            close_block()
            element = name
            # a paragraph ends where the next block begins; list items and cells
            # where the next of their kind does
            ends = SIBLINGS.get(name, frozenset()) | {"p"}
            while (k := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK), -1)) >= 0 and stack[k][0] in ends:
                leave(k)
            if name in MAIN:
                # a menu that nobody closed ends where the main text begins
                for i, e in enumerate(stack):
                    if e[3]:
                        leave(i)
                        break
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        skipped, main = stack[-1][1:3] if stack else (False, False)
        by_class, by_role = marked(m[3])
        own = name in SKIPPED or (by_class and name not in NEVER_BY_CLASS)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if name in BLOCK or own:
            stack.append((name, skipped or own, main or name in MAIN or by_role, own and m.start() in open_for_ever))
            inside += name not in BLOCK
    close_block()
    return out


def unclosed(page: str) -> set[int]:
    """Places of the tags of skipped blocks that are never closed."""
    low, out = page.lower(), set()
    for name in UNCLOSED:
        if low.count(f"<{name}") == low.count(f"</{name}"):
            continue
        waiting: list[int] = []
        for m in re.finditer(rf"<(/?){name}(?=[\s/>])", low):
            if not m[1]:
                waiting.append(m.start())
            elif waiting:
                waiting.pop()
        out.update(waiting)
    return out


def sorted_to(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of suffixes by their first ``depth`` tokens (prefix doubling)."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        nxt = np.full(len(rank), -1, np.int64)
        nxt[: len(rank) - step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + nxt + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def repeated(tokens: np.ndarray, page: np.ndarray, least: int = LEAST_RUN) -> np.ndarray:
    """Tokens inside runs of at least ``least`` that stand on distinct pages."""
    if len(tokens) < least:
        return np.zeros(len(tokens), bool)
    rank = sorted_to(tokens, least)
    order = np.argsort(rank, kind="stable")  # the suffix array to that depth
    r, p = rank[order], page[order]
    head = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    low, high = np.minimum.reduceat(p, head), np.maximum.reduceat(p, head)
    many = np.repeat(low != high, np.diff(np.concatenate((head, [len(r)]))))
    starts = np.zeros(len(tokens) + 1, np.int64)
    at = order[many]
    at = at[at + least <= len(tokens)]
    starts[at] += 1
    np.subtract.at(starts, at + least, 1)
    return np.cumsum(starts)[:-1] > 0


def left_of(text: str, covered: np.ndarray, least: int) -> str:
    """A block's words after its repeated pieces are cut.

    ``covered`` tells it of the block's mark and of each word.  A piece shorter
    than ``least``, the end of a run that reaches over from a neighbour, is cut
    only if it is the whole block.
    """
    if not covered.any():
        return text
    if covered.all():
        return ""
    turn = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    gone = np.zeros(len(covered), bool)
    for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
        gone[a:b] = b - a >= least
    return " ".join(w for w, g in zip(text.split(" "), gone[1:].tolist(), strict=True) if not g)


def streams(pages: list[list[Block]], hosts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run that starts at each token, whether it fits in its page, tokens that may
    be kept, first token of each page with a closing bound), main text left out."""
    loose = [[b for b in blocks if b.skipped or not b.main] for blocks in pages]
    words, bounds = word_hashes([" ".join(f"<{b.element} {b.text}" for b in blocks).encode("utf-8", "replace") for blocks in loose])[:2]
    own = [np.full(b.text.count(" ") + 2, not b.skipped) for blocks in loose for b in blocks]
    size = np.diff(bounds)
    run = np.repeat(mix64(hosts.view(U64)), size)
    padded = np.concatenate((words, np.zeros(least, U64)))
    for i in range(least):
        run = mix64(run * U64(0x9E3779B97F4A7C15) + padded[i : i + len(words)])
    fits = np.arange(len(words)) + least <= np.repeat(bounds[1:], size)
    return run.view(np.int64), fits, np.concatenate(own) if own else np.zeros(0, bool), bounds


def _runs(least: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pages = [blocks_of(t if isinstance(t, str) else None) for t in pdf["html"]]
            runs, fits, own, bounds = streams(pages, pdf["host"].to_numpy(np.int64), least)
            total = np.concatenate((np.cumsum(np.concatenate(([0], own))), np.full(least, own.sum())))
            use = fits & (total[least : least + len(own)] > total[: len(own)])
            parts = [slice(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            out = pd.DataFrame({"page": pdf["page"], "runs": [np.unique(runs[p][fits[p]]) for p in parts], "own": [np.unique(runs[p][use[p]]) for p in parts]})
            yield out[[len(r) > 0 for r in out["runs"]]]

    return run


def main_text(blocks: list[Block], covered: np.ndarray, least: int) -> str:
    """The main text of a page whose tokens in repeated runs are known."""
    kept, at = [], 0
    for b in blocks:
        text = b.text
        if b.skipped or not b.main:
            n = text.count(" ") + 2
            text = "" if b.skipped else left_of(text, covered[at : at + n], least)
            at += n
        if text:
            kept.append(text)
    return "\n\n".join(kept)


def _texts(least: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pages = [blocks_of(t if isinstance(t, str) else None) for t in pdf["html"]]
            found = [f if f is not None and len(f) else None for f in pdf["found"]]
            some = [i for i, f in enumerate(found) if f is not None]
            runs, fits, _, bounds = streams([pages[i] for i in some], pdf["host"].to_numpy(np.int64)[some], least)
            covered = {}
            for k, i in enumerate(some):
                a, b = int(bounds[k]), int(bounds[k + 1])
                at = np.flatnonzero(fits[a:b] & np.isin(runs[a:b], np.asarray(found[i], np.int64)))
                turn = np.zeros(b - a + 1, np.int64)
                turn[at] += 1
                np.subtract.at(turn, at + least, 1)
                covered[i] = np.cumsum(turn)[:-1] > 0
            texts = [main_text(blocks, covered.get(i, np.zeros(0, bool)), least) for i, blocks in enumerate(pages)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return run


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_RUN) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``df``."""
    spark, kind = df.sparkSession, dict(df.dtypes)[id_col]
    bounded_batches(spark)
    i, u, h = df[id_col], df[url_col], df[html_col]
    rows = df.select(F.xxhash64(host_path(u)[0]).alias("host"), F.xxhash64(i, u, h).alias("page"), i.cast("string").alias("page_id"), u.alias("url"), h.alias("html"))
    seen = materialize(spark, rows.select("host", "page", "html").mapInPandas(_runs(least), "page long, runs array<long>, own array<long>"))
    own = seen.where(F.size("own") > 0).select("page", F.explode("own").alias("run"))
    if own.isEmpty():
        dealt = rows.withColumn("found", F.lit(None).cast("array<long>"))
    else:
        pages = seen.select("page", F.explode("runs").alias("run")).groupBy("run").agg(F.min("page").alias("low"), F.max("page").alias("high"))
        # written, so that the join sees its size and can split a run of many pages
        repeats = materialize(spark, pages.where("low <> high").select("run"))
        found = materialize(spark, own.join(repeats, "run").groupBy("page").agg(F.collect_set("run").alias("found")))
        dealt = rows.join(found, "page", "left")
    out = dealt.select("host", "page_id", "url", "html", "found").mapInPandas(_texts(least), "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumnsRenamed({"page_id": id_col, "url": url_col})
