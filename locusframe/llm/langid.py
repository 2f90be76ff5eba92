"""Language ID: a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's UTF-8 bytes forwards and backwards, a
softmax layer labels every byte, and a text's probabilities are the mean over
all of its bytes.  The network is trained in numpy by backpropagation through
time on short windows with Adam.

A text is cut into windows of ``WINDOW`` bytes that are read side by side, so
every byte is labelled and work and memory are linear in the text.

Training reads a bounded sample of every language: about ``ROWS_PER_LANGUAGE``
texts of each, chosen by a hash of the id, fewer where that is more than
``SAMPLE`` texts in all, and ``SNIPPETS`` windows of each.  More languages than
``MOST_LANGUAGES`` are too many to train and raise an error.  The fold
asked to be held out is never read.

Defined results: null texts and texts without a letter get ``und`` with score
0; with no labelled text to learn from, so do all.  Repeated rows get equal
results; ids pass through, be they null (never learned from, never held out),
repeated or strings; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_before, as_text, batches, bounded_batches
from .toxicity import held_out

HIDDEN = 8
WINDOW = 128
TRAIN_WINDOW = 48
SNIPPETS = 4
ROWS_PER_LANGUAGE = 400
SAMPLE = 64 * ROWS_PER_LANGUAGE
MOST_LANGUAGES = 512
STEPS, BATCH, RATE = 260, 192, 0.02
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Direction:
    """Gates in the order reset, update, candidate; byte inputs as a table."""

    table: np.ndarray  # 3H x 256
    turn: np.ndarray  # 3H x H
    bias: np.ndarray  # 3H x 1, added to the recurrent part

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Direction:
        h = HIDDEN
        return cls(
            rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32), rng.normal(0, h**-0.5, (3 * h, h)).astype(np.float32), np.zeros((3 * h, 1), np.float32)
        )

    def params(self) -> list[np.ndarray]:
        return [self.table, self.turn, self.bias]

    def run(self, steps: np.ndarray, keep: bool = False):
        """steps: T x B bytes.  States T x H x B (and what backward needs)."""
        h_n = HIDDEN
        t_n, b_n = steps.shape
        states = np.empty((t_n, h_n, b_n), np.float32)
        h = np.zeros((h_n, b_n), np.float32)
        kept = []
        x = np.empty((3 * h_n, b_n), np.float32)
        u = np.empty((3 * h_n, b_n), np.float32)
        for t in range(t_n):
            np.take(self.table, steps[t], axis=1, out=x, mode="clip")
            np.matmul(self.turn, h, out=u)
            u += self.bias
            # sigmoid(v) = (1 + tanh(v / 2)) / 2
            gates = x[: 2 * h_n] + u[: 2 * h_n]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            r, z = gates[:h_n], gates[h_n:]
            n = r * u[2 * h_n :]
            n += x[2 * h_n :]
            np.tanh(n, out=n)
            if keep:
                kept.append((h, r, z, n, u[2 * h_n :].copy()))
            new = states[t]
            np.subtract(h, n, out=new)
            new *= z
            new += n
            h = new
        return (states, kept) if keep else states

    def back(self, steps: np.ndarray, kept: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters from those of the states (T x H x B)."""
        h_n = HIDDEN
        g_table, g_turn, g_bias = np.zeros_like(self.table), np.zeros_like(self.turn), np.zeros_like(self.bias)
        carry = np.zeros_like(grad[0])
        for t in range(len(steps) - 1, -1, -1):
            h, r, z, n, u_n = kept[t]
            g = grad[t] + carry
            g_n = g * (1 - z) * (1 - n * n)
            g_z = g * (h - n) * z * (1 - z)
            g_r = g_n * u_n * r * (1 - r)
            g_x = np.concatenate((g_r, g_z, g_n))
            g_u = np.concatenate((g_r, g_z, g_n * r))
            g_turn += g_u @ h.T
            g_bias += g_u.sum(axis=1, keepdims=True)
            one = np.zeros((256, len(steps[t])), np.float32)
            one[steps[t], np.arange(len(steps[t]))] = 1
            g_table += g_x @ one.T
            carry = g * z + self.turn.T @ g_u
        return [g_table, g_turn, g_bias]


@dataclass
class Network:
    languages: list[str]
    forth: Direction
    back: Direction
    out: np.ndarray  # C x 2H
    out_bias: np.ndarray  # C x 1

    def label(self, windows: np.ndarray) -> np.ndarray:
        """T x C x B probabilities of every byte of windows (B x T)."""
        steps = np.ascontiguousarray(windows.T).astype(np.intp)
        a = self.forth.run(steps)
        b = self.back.run(steps[::-1])[::-1]
        logits = self.out[:, :HIDDEN] @ a + self.out[:, HIDDEN:] @ b + self.out_bias
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text over all of its bytes."""
        lens = np.array([len(t) for t in texts], np.int64)
        n_win = -(-lens // WINDOW)
        buf = np.zeros(int(n_win.sum()) * WINDOW, np.uint8)
        first = np.cumsum(n_win) - n_win
        for t, w in zip(texts, first.tolist(), strict=True):
            buf[w * WINDOW : w * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
        win = buf.reshape(-1, WINDOW)
        of = np.repeat(np.arange(len(texts)), n_win)
        used = np.minimum(lens[of] - (np.arange(len(win)) - first[of]) * WINDOW, WINDOW)
        out = np.zeros((len(texts), len(self.languages)))
        for lo in range(0, len(win), 1024):
            p = self.label(win[lo : lo + 1024])
            inside = np.arange(WINDOW)[:, None] < used[lo : lo + 1024][None, :]
            np.add.at(out, of[lo : lo + 1024], np.einsum("tcb,tb->bc", p, inside.astype(np.float32)).astype(np.float64))
        return out / np.maximum(lens, 1)[:, None]


def snippets(texts: list[bytes], labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    rows, out = [], []
    for t, y in zip(texts, labels.tolist(), strict=True):
        for _ in range(SNIPPETS):
            at = int(rng.integers(0, max(1, len(t) - TRAIN_WINDOW + 1)))
            piece = t[at : at + TRAIN_WINDOW]
            rows.append(np.frombuffer(piece.ljust(TRAIN_WINDOW, b"\0"), np.uint8))
            out.append(y)
    return np.stack(rows), np.array(out)


def train(texts: list[bytes], labels: list[str], seed: int = 5) -> Network | None:
    """Cross-entropy at every byte, languages weighted alike."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(v) for v in labels])
    x, y = snippets(texts, y, rng)
    c = len(languages)
    net = Network(languages, Direction.fresh(rng), Direction.fresh(rng), rng.normal(0, 0.3, (c, 2 * HIDDEN)).astype(np.float32), np.zeros((c, 1), np.float32))
    params = [*net.forth.params(), *net.back.params(), net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_language = [np.flatnonzero(y == k) for k in range(c)]
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(rows, max(1, BATCH // c)) for rows in by_language])
        steps = np.ascontiguousarray(x[pick].T).astype(np.intp)
        a, kept_a = net.forth.run(steps, keep=True)
        b, kept_b = net.back.run(steps[::-1], keep=True)
        b = b[::-1]
        logits = net.out[:, :HIDDEN] @ a + net.out[:, HIDDEN:] @ b + net.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        g = p
        g[:, y[pick], np.arange(len(pick))] -= 1
        g *= (steps != 0)[:, None, :] / np.float32(max(1, (steps != 0).sum()))
        g_out = np.concatenate((np.einsum("tcb,thb->ch", g, a), np.einsum("tcb,thb->ch", g, b)), axis=1)
        g_a = np.matmul(net.out[:, :HIDDEN].T, g)
        g_b = np.matmul(net.out[:, HIDDEN:].T, g)
        grads = [*net.forth.back(steps, kept_a, g_a), *net.back.back(steps[::-1], kept_b, g_b[::-1]), g_out, g.sum(axis=(0, 2))[:, None]]
        size = np.sqrt(sum(float((v * v).sum()) for v in grads))
        scale = min(1.0, 1.0 / (size + 1e-9))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for v, gr, m, s in zip(params, grads, first, second, strict=True):
            gr = gr * np.float32(scale)
            m += 0.1 * (gr - m)
            s += 0.01 * (gr * gr - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on a bounded sample of the rows outside the held-out fold."""
    rows = df.select(df[id_col].alias("i"), df[text_col].alias("t"), df[lang_col].alias("y"))
    known = rows.where(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("i")))
    counts = known.groupBy("y").count()
    # one more than can be trained tells that there are too many
    n = len(counts.limit(MOST_LANGUAGES + 1).collect())
    if not n:
        return None
    if n > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang_col}: too many to train")
    share = F.pmod(F.xxhash64("i"), F.lit(1 << 40)) / float(1 << 40)
    rate = F.lit(min(ROWS_PER_LANGUAGE, SAMPLE / n)) / F.col("count")
    got = known.where(F.col("t").isNotNull()).join(F.broadcast(counts), "y").where(share <= rate).select("i", "t", "y").orderBy(share, "i", "t").limit(2 * SAMPLE).collect()
    got = [r for r in got if LETTER.search(r["t"])]
    got.sort(key=lambda r: (zlib.crc32(str(r["i"]).encode()), str(r["i"]), r["y"], r["t"]))
    return train([r["t"].encode("utf-8", "replace") for r in got], [r["y"] for r in got]) if got else None


def predict(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row: whole texts, one narrow pass."""
    bounded_batches(df.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = [t.encode("utf-8", "replace") if isinstance(t, str) and LETTER.search(t) else b"" for t in pdf[text_col]]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for lo, hi in batches(texts, 1 << 19) if net is not None else ():
                p = net.pool(texts[lo:hi])
                best = p.argmax(axis=1)
                for k in range(hi - lo):
                    if texts[lo + k]:
                        names[lo + k] = net.languages[best[k]]
                        scores[lo + k] = min(1.0, p[k, best[k]])
            yield pd.DataFrame({id_col: pdf[id_col], "lang_pred": names, "score": scores})

    out = df.select(as_text(df, id_col), df[text_col]).mapInPandas(run, f"{id_col} string, lang_pred string, score double")
    return as_before(out, df, id_col)


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``."""
    out = predict(docs, learn(docs))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
