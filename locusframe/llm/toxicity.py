"""Toxicity: a convolutional text classifier trained in numpy.

Words (lower-cased runs of letters, digits and non-ASCII characters) get an
embedding that is the sum of two hashed rows, one for the word and one for its
first bytes, so inflected forms share evidence; the first dimension starts from the
labels' shrunk log odds and the others small, so an unseen word stays neutral.
Filters of several widths run over the words, each is max-pooled over the
whole text, and a logistic layer reads the pooled values.  Because pooling
keeps one place a filter, gradients are sparse.

Thresholds are calibrated by language: on rows kept from training, each guessed
language gets the threshold with the best balance of hits and false alarms;
scores are then stretched so that this threshold reads as ``CUT``.  The
language is guessed from function words of the text itself.

Training reads at most ``MOST_ROWS`` labelled rows of each class, those with
the smallest hash of their id; scoring reads every whole text in one narrow
pass.  Null and empty texts are scored as texts without words.  Ids pass
through, be they null (never learned from, never held out), repeated or strings.
An id labelled twice counts with each label; of a labelled id that repeats among
the documents, the first text by value is learned from.
Without labelled rows of both classes every score is 0.  Other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, RollingHash, as_before, as_text, batches, bounded_batches, mix64, release_memory, word_bounds

MOST_ROWS = 1_500
SLOTS = 1 << 15
DIM, FILTERS, WIDTHS = 8, 4, (1, 2, 3)
HEAD_BYTES = 4
EPOCHS, RATE, BATCH = 8, 0.15, 32
LEAST_STEPS = 500
#: A language with fewer kept rows of a class takes the common threshold.
LEAST_HITS = 15
CUT = 0.7

# fixed values: frequent function words of some languages
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as be at this from",
    "fr": "le la les des et en un une du que qui dans pour pas sur par est avec",
    "de": "der die das und ist nicht von den mit im zu ein eine auf für dem sich als",
    "es": "el los las y que del se por con para una su al lo como no más es",
    "it": "il di che è per un non sono con del della le gli nel alla dei una più",
    "pt": "o os e do da em um para com não uma na no dos mais como ao das",
    "nl": "de het een van en is op te dat niet zijn voor met er aan ook maar bij",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def held_out(id_col: Column) -> Column:
    """True for the fold that no model learns from."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word slots, head slots, word hashes, first word of each text)."""
    raw = [t.lower().encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
    word, head, hashes, counts = [], [], [], [np.zeros(1, np.int64)]
    for lo, hi in batches(raw):
        buf, ws, we, n = word_bounds(raw[lo:hi])
        roll = RollingHash(buf)
        size = (we - ws).astype(U64)
        h = mix64(roll.of(ws, we) + size)
        short = np.minimum(we, ws + HEAD_BYTES)
        g = mix64(roll.of(ws, short) + U64(77))
        word.append((h % U64(SLOTS)).astype(np.int32))
        head.append((g % U64(SLOTS)).astype(np.int32))
        hashes.append(h)
        counts.append(n)
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return cat(word, np.int32), cat(head, np.int32), cat(hashes, U64), np.cumsum(np.concatenate(counts))


def _function_table() -> np.ndarray:
    table = np.zeros(1 << 16, np.int8)
    for k, words in enumerate(FUNCTION_WORDS.values(), 1):
        h = features([words])[2]
        table[(h & U64(0xFFFF)).astype(np.int64)] = k
    return table


def guess_language(hashes: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index into ``LANGUAGES`` by the most function words."""
    hit = table[(hashes & U64(0xFFFF)).astype(np.int64)]
    out = np.zeros((len(bounds) - 1, len(FUNCTION_WORDS)), np.int64)
    for k in range(len(FUNCTION_WORDS)):
        total = np.concatenate(([0], np.cumsum(hit == k + 1)))
        out[:, k] = total[bounds[1:]] - total[bounds[:-1]]
    return np.where(out.max(axis=1) > 0, out.argmax(axis=1), len(FUNCTION_WORDS))


@dataclass
class Model:
    word: np.ndarray
    head: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    cuts: np.ndarray = field(default_factory=lambda: np.full(len(LANGUAGES), 0.5))
    trained: bool = False

    @classmethod
    def fresh(cls, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        z = lambda: rng.normal(0, 0.1, (SLOTS, DIM)).astype(np.float32)
        f = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(z(), z(), f, np.zeros(n, np.float32), rng.normal(0.5, 0.1, n).astype(np.float32), 0.0)

    def pooled(self, word: np.ndarray, head: np.ndarray, bounds: np.ndarray, places: bool = False):
        """Pooled filter values of each text (and their places)."""
        n = FILTERS * len(WIDTHS)
        texts = len(bounds) - 1
        out = np.zeros((texts, n), np.float32)
        at = np.full((texts, n), -1, np.int64)
        if not len(word):
            return (out, at) if places else out
        x = self.word[word] + self.head[head]
        for k, f in enumerate(self.filters):
            w = f.shape[0]
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            z = x @ f[0]
            for j in range(1, w):
                z[:-j] += x[j:] @ f[j]
            z += self.bias[cols]
            n_places = np.diff(bounds) - (w - 1)
            for t in np.flatnonzero(n_places > 0).tolist() if places else ():
                a = bounds[t]
                best = z[a : a + n_places[t]].argmax(axis=0)
                at[t, cols] = a + best
                out[t, cols] = z[a + best, np.arange(FILTERS)]
            if not places:
                ok = n_places > 0
                # the places whose filter would reach into the next text do not count
                for j in range(1, w):
                    z[np.maximum(bounds[1:] - j, bounds[:-1])[np.diff(bounds) > 0]] = -np.inf
                full = np.flatnonzero(ok)
                if len(full):
                    starts = np.flatnonzero(np.diff(bounds) > 0)
                    best = np.maximum.reduceat(z, bounds[:-1][starts], axis=0)
                    out[starts, cols] = np.where(np.isfinite(best), best, 0)
        out = np.maximum(out, 0)
        return (out, at) if places else out

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -30, 30).astype(np.float64)))

    def stretch(self, p: np.ndarray, language: np.ndarray) -> np.ndarray:
        t = self.cuts[language]
        return np.where(p < t, p / t * CUT, CUT + (p - t) / (1 - t) * (1 - CUT))


def label_odds(slots: np.ndarray, bounds: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shrunk log odds of a text's label given that it holds a slot."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    own = np.isin(np.arange(len(bounds) - 1), rows)[text]
    pair = np.unique(text[own] * SLOTS + slots[own])
    hit, slot = y[pair // SLOTS] > 0, pair % SLOTS
    pos = np.bincount(slot[hit], minlength=SLOTS).astype(np.float64)
    neg = np.bincount(slot[~hit], minlength=SLOTS).astype(np.float64)
    n_pos, n_neg = float((y[rows] > 0).sum()), float((y[rows] <= 0).sum())
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    return np.clip(odds * (pos + neg) / (pos + neg + 3), -3, 4)


def fit(texts: list[str | None], labels: np.ndarray, seed: int = 3) -> Model:
    """Train on four fifths of the rows, calibrate on the rest."""
    model = Model.fresh(seed)
    y = labels.astype(np.float32)
    if len(y) < 10 or y.min() == y.max():
        return model
    word, head, hashes, bounds = features(texts)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    check, train = order[: len(y) // 5], order[len(y) // 5 :]
    pos = max(float(y[train].mean()), 1e-3)
    # the first dimension starts from how the labels lean, read by one filter a width
    for rows_of, slots in ((model.word, word), (model.head, head)):
        rows_of[:, 0] = 0.5 * label_odds(slots, bounds, train, y)
    for f in model.filters:
        f[:, 0, 0] = 1 / f.shape[0]
    weight = np.where(y > 0, 0.5 / pos, 0.5 / (1 - pos + 1e-6)).astype(np.float32)
    sums = {k: np.full_like(v, 1e-2) for k, v in (("word", model.word), ("head", model.head), ("bias", model.bias), ("out", model.out))}
    f_sums = [np.full_like(f, 1e-2) for f in model.filters]
    b_sum = 1e-2

    def step(value, total, grad):
        total += grad * grad
        value -= RATE * grad / np.sqrt(total)

    for _ in range(max(EPOCHS, LEAST_STEPS * BATCH // len(train))):
        rng.shuffle(train)
        for lo in range(0, len(train), BATCH):
            rows = train[lo : lo + BATCH]
            own = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
            b = np.concatenate(([0], np.cumsum(bounds[rows + 1] - bounds[rows])))
            w_ids, h_ids = word[own], head[own]
            pooled, at = model.pooled(w_ids, h_ids, b, places=True)
            p = model.raw(pooled).astype(np.float32)
            err = (p - y[rows]) * weight[rows] / len(rows)
            g_out = pooled.T @ err
            g_pool = err[:, None] * model.out[None, :] * (pooled > 0)
            step(model.out, sums["out"], g_out)
            g_b = float(err.sum())
            b_sum += g_b * g_b
            model.out_bias -= RATE * g_b / np.sqrt(b_sum)
            step(model.bias, sums["bias"], g_pool.sum(axis=0))
            ids_w, ids_h, grads = [], [], []
            for k, f in enumerate(model.filters):
                g_f = np.zeros_like(f)
                for c in range(FILTERS):
                    col = k * FILTERS + c
                    live = np.flatnonzero((at[:, col] >= 0) & (g_pool[:, col] != 0))
                    if not len(live):
                        continue
                    g = g_pool[live, col][:, None]
                    for j in range(f.shape[0]):
                        place = at[live, col] + j
                        x = model.word[w_ids[place]] + model.head[h_ids[place]]
                        g_f[j, :, c] += (x * g).sum(axis=0)
                        ids_w.append(w_ids[place])
                        ids_h.append(h_ids[place])
                        grads.append(g * f[j, :, c][None, :])
                step(f, f_sums[k], g_f)
            if grads:
                g = np.concatenate(grads)
                for value, total, ids in ((model.word, sums["word"], np.concatenate(ids_w)), (model.head, sums["head"], np.concatenate(ids_h))):
                    u, inv = np.unique(ids, return_inverse=True)
                    acc = np.zeros((len(u), DIM), np.float32)
                    np.add.at(acc, inv, g)
                    total[u] += acc * acc
                    value[u] -= RATE * acc / np.sqrt(total[u])
    model.trained = True
    language = guess_language(hashes, bounds, _function_table())
    p = model.raw(model.pooled(word, head, bounds))

    def best_cut(rows: np.ndarray) -> float | None:
        hit = y[rows] > 0
        if hit.sum() < LEAST_HITS or (~hit).sum() < LEAST_HITS:
            return None
        grid = np.unique(np.clip(np.concatenate((p[rows], [0.5])), 0.02, 0.98))
        grid = np.concatenate(((grid[:-1] + grid[1:]) / 2, [0.5])) if len(grid) > 1 else grid
        score = [((p[rows][hit] >= c).mean() - 2 * (p[rows][~hit] >= c).mean(), -abs(c - 0.5)) for c in grid]
        return float(grid[max(range(len(grid)), key=lambda i: score[i])])

    base = best_cut(check) or 0.5
    model.cuts[:] = base
    for k in range(len(LANGUAGES)):
        own = check[language[check] == k]
        cut = best_cut(own)
        if cut is not None:
            model.cuts[k] = cut
    model.cuts = np.clip(model.cuts, 0.02, 0.98)
    return model


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    known = labels.select(labels[id_col].alias("_id"), labels[label_col].alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    ids: list[tuple] = []
    for y in (0, 1):
        ids += [tuple(r) for r in known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(MOST_ROWS).collect()]
    if not ids:
        return Model.fresh()
    # at most 2 * MOST_ROWS ids: a bounded broadcast
    sample = spark.createDataFrame(ids, known.schema)
    rows = docs.select(docs[id_col].alias("_d"), docs[text_col].alias("_t")).join(F.broadcast(sample), F.col("_d") == F.col("_id")).groupBy("_d", "_y").agg(F.min("_t").alias("_t")).select("_d", "_t", "_y").collect()
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), r[2]))
    return fit([r[1] for r in rows], np.array([r[2] for r in rows]))


def scores_of(texts: list[str | None], model: Model, table: np.ndarray) -> np.ndarray:
    if not model.trained or not texts:
        return np.zeros(len(texts))
    out = []
    for lo, hi in batches([t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts], 1 << 19):
        word, head, hashes, bounds = features(texts[lo:hi])
        p = model.raw(model.pooled(word, head, bounds))
        out.append(model.stretch(p, guess_language(hashes, bounds, table)))
    return np.concatenate(out)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    bounded_batches(df.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _function_table()
        for pdf in it:
            yield pd.DataFrame({id_col: pdf[id_col], "score": scores_of(list(pdf[text_col]), model, table)})

    out = df.select(as_text(df, id_col), df[text_col]).mapInPandas(run, f"{id_col} string, score double")
    return as_before(out, df, id_col)


def keep_clean(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows that are not scored as toxic, with their columns as they are."""

    bounded_batches(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _function_table()
        try:
            for batch in it:
                yield batch.filter(pa.array(scores_of(batch.column(text_col).to_pylist(), model, table) < CUT))
        finally:
            release_memory()

    return df.mapInArrow(run, df.schema)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    scored = score(docs, learn(spark, docs, labels))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
