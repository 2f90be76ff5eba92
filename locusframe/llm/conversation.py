"""Conversation structure repair by a dynamic program shared along a trie.

A conversation is read as a signature, one sign per row: the role's initial (or
``o`` for any other), in upper case where the text is truncated, or ``x`` where
the row must go.  Its cheapest repair depends on the signature alone.  Signatures
are range-partitioned and sorted, so that each task walks the prefix trie of its
range depth first: it holds the layers of the current path, computes one layer
for each edge of the trie, whatever the number of signatures below it, and
answers at terminal nodes.  A layer has, for each end of the repaired roles (none,
``s``, ``u``, ``a``), the cost and the way back; layers that differ by a constant
cost are one, so what follows from a layer and a sign is worked out once.

Texts never meet the trie: the edits go back to the rows in pieces of
``PIECE`` rows, and the repaired text is hashed as a stream in order.  Of a
conversation only its signature and its edits (a few bytes a row) are held whole.

Defined results: a null role or text is one space.  Rows of one turn are ordered by role
and then text, null turns first; a null conversation id is a conversation of its
own; a conversation without rows has zeros, an empty audit and the digest of the
empty text.  Roles are told by their first sign, empty ones by none.  Repeated
rows are faults by the rules (duplicates); an empty table gives an empty table;
other columns are never read.  Texts and conversations of any length are handled
whole.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_before, bounded_batches, discard, materialize

# fixed values: costs of the edits, and of a truncated row that stays
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# fixed values: the damage of rows by their remainder
DROP, EMPTY, UNSTOP, REPEAT, AS_USER, REMAINDERS = 0, 1, 2, 3, 4, 20

BLANKS = " \t\n\x0b\x0c\r"
#: Rows whose edits travel together.
PIECE = 1024

# ends of the repaired roles so far
NONE, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 60


def _after_turn(end: int) -> int:
    """The end after a user or assistant row is put where it fits."""
    return ASSISTANT if end == USER else USER


def _moves(sign: str) -> list[tuple[int, int, int, str]]:
    """(end before, end after, cost, edits) of a row, with inserts before it."""
    out = []
    extra = TRUNCATED if sign.isupper() else 0
    for start in range(4):
        end = start
        for inserts in range(3):  # a third would only come back to the first
            put, cost = "I" * inserts, INSERT * inserts
            out.append((start, end, cost + DELETE, put + "D"))
            if sign != "x":
                out.append((start, _after_turn(end), cost + REROLE + extra, put + "R"))
                role = sign.lower()
                if role == "s" and end == NONE:
                    out.append((start, SYSTEM, cost + KEEP + extra, put + "K"))
                elif role == ("a" if end == USER else "u"):
                    out.append((start, _after_turn(end), cost + KEEP + extra, put + "K"))
            end = _after_turn(end)
    return out


class RepairTrie:
    """The path of a depth-first walk over the trie of sorted signatures.

    ``path[i]`` is the layer behind the first i signs; equal signatures and
    shared prefixes keep their layers.  ``layers_made`` counts the trie's edges.
    """

    def __init__(self) -> None:
        first = ((0, _FAR, _FAR, _FAR), (0, 1, 2, 3))
        self.layers = [first]
        self.number = {first: 0}
        self.next: dict[tuple[int, str], tuple[int, int, int]] = {}
        self.backs: list[tuple] = [()]
        self.moves = {sign: _moves(sign) for sign in "suaoSUAOx"}
        self.path, self.back, self.costs = array("q", [0]), array("q", [0]), array("q", [0])
        self.signs = ""
        self.layers_made = 0

    def _step(self, layer: int, sign: str) -> tuple[int, int, int]:
        """(next layer, ways back, cost added to all) of a layer and a sign.

        Among equal costs the audit that is least in ASCII order leads: paths of
        one layer end in a row's edit, so none is the beginning of another, and
        their order (``ranks``) stays whatever follows.
        """
        costs, ranks = self.layers[layer]
        best: list[tuple] = [(_FAR, 0, "", 0)] * 4
        for start, end, cost, edits in self.moves[sign]:
            if costs[start] < _FAR:
                best[end] = min(best[end], (costs[start] + cost, ranks[start], edits, start))
        least = min(b[0] for b in best)
        order = sorted(range(4), key=lambda e: (best[e][0] == _FAR, best[e][1:3]))
        made = tuple(b[0] - least if b[0] < _FAR else _FAR for b in best), tuple(order.index(e) for e in range(4))
        number = self.number.setdefault(made, len(self.layers))
        if number == len(self.layers):
            self.layers.append(made)
        self.backs.append(tuple((b[3], b[2]) for b in best))
        return number, len(self.backs) - 1, least

    def repair(self, signature: str) -> tuple[int, list[str]]:
        """(cost, the edits of each row and those behind the last)."""
        shared = 0
        for a, b in zip(self.signs, signature, strict=False):
            if a != b:
                break
            shared += 1
        for kept in (self.path, self.back, self.costs):
            del kept[shared + 1 :]
        for sign in signature[shared:]:
            at = self.path[-1], sign
            found = self.next.get(at)
            if found is None:
                found = self.next[at] = self._step(*at)
            self.path.append(found[0])
            self.back.append(found[1])
            self.costs.append(self.costs[-1] + found[2])
            self.layers_made += 1
        self.signs = signature
        # whole roles end in nothing or an assistant: close what is open
        costs, ranks = self.layers[self.path[-1]]
        cost, _, closing, end = min(
            (costs[e] + INSERT * n, ranks[e], "I" * n, e) for e, n in ((NONE, 0), (SYSTEM, 2), (USER, 1), (ASSISTANT, 0))
        )
        edits = [closing]
        for i in range(len(signature), 0, -1):
            end, done = self.backs[self.back[i]][end]
            edits.append(done)
        edits.reverse()
        return self.costs[-1] + cost, edits


def damaged(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, gone): rows as the damage leaves them; dropped
    rows stay as ``gone``, so that no conversation is lost."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(blank(conv_col), F.lit(":"), blank(turn_col))
    kind = F.crc32(key) % REMAINDERS
    rows = df.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), kind.alias("kind"))
    return rows.select(
        "conv", F.when(F.col("kind") != DROP, F.col("turn")).alias("turn"),
        F.when(F.col("kind") == AS_USER, "user").when(F.col("kind") != DROP, F.col("role")).alias("role"),
        F.when(F.col("kind") == EMPTY, "").when(F.col("kind") == UNSTOP, F.translate("text", ".!?", "")).when(F.col("kind") != DROP, F.col("text")).alias("text"),
        (F.col("kind") == DROP).alias("gone"),
        F.explode(F.when(F.col("kind") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def undamaged(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The same columns for rows as they are."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), F.lit(False).alias("gone"), F.lit(0).alias("copy"))


def _sign(initial: Column, fault: Column) -> Column:
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(role)).otherwise(role)


def faults(rows: DataFrame) -> DataFrame:
    """(conv, place, turn, role, text, gone, fault, illegal, fresh, sign) in order."""
    order = Window.partitionBy("conv").orderBy("gone", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    again = Window.partitionBy("conv", "gone", "role", "text").orderBy("place")
    initial = F.substring("role", 1, 1)
    placed = rows.withColumn("initial", initial).select(
        "*", F.row_number().over(order).cast("long").alias("place"), F.lag("initial").over(order).alias("before"), F.lag("turn").over(order).alias("last")
    )
    body = F.rtrim("text", F.lit(BLANKS))
    told = placed.select("*", F.row_number().over(again).alias("nth"), F.right(body, F.lit(1)).alias("stop"))
    fault = F.when(F.col("gone"), None).when(F.col("stop") == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("stop").isin(".", "!", "?"), "truncated")
    illegal = ~F.col("gone") & F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last"))
    return told.select("conv", "place", "turn", "role", "text", "gone", fault.alias("fault"), F.coalesce(illegal, F.lit(False)).alias("illegal"), fresh.alias("fresh")).withColumn(
        "sign", F.when(~F.col("gone"), _sign(initial, F.coalesce("fault", F.lit("")))))


def signatures(told: DataFrame) -> DataFrame:
    """Per conversation: counts and its signature, gathered piece by piece."""
    joined = lambda of: F.array_join(F.transform(F.array_sort(F.collect_list(of)), lambda s: s["sign"]), "")
    one = told.groupBy("conv", F.floor((F.col("place") - 1) / PIECE).alias("part")).agg(
        joined(F.when(~F.col("gone"), F.struct("place", "sign"))).alias("sign"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_if("fresh").alias("turns"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], F.count_if("illegal").alias("illegal"),
    )
    whole = one.groupBy("conv").agg(
        joined(F.struct("part", "sign")).alias("signature"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")]
    )
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return whole.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "signature")


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def edits(conversations: DataFrame) -> DataFrame:
    """(conv, counts, cost, part, edits): the cheapest edits in pieces of rows."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = RepairTrie()
        for pdf in it:
            out = []
            for row in pdf.itertuples(index=False):
                cost, done = trie.repair(row.signature)
                for part, at in enumerate(range(0, max(1, len(done) - 1), PIECE)):
                    last = at + PIECE >= len(done) - 1
                    out.append((*row[:-1], cost, part, ",".join(done[at : at + PIECE + last])))
            yield pd.DataFrame(out, columns=[*pdf.columns[:-1], "cost", "part", "edits"])

    # a frequent signature is split by conversation
    dealt = conversations.repartitionByRange("signature", "conv").sortWithinPartitions("signature", "conv")
    return dealt.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "signature").mapInPandas(run, f"conv string, {_COUNTS}, cost long, part long, edits string")


class _Repaired:
    """The repaired text of one conversation, as a running digest."""

    def __init__(self, head: tuple):
        self.head, self.audit = head, []
        self.sha, self.end, self.begun = hashlib.sha256(), NONE, False
        self.waiting: list[str] = []

    def _put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) * self.begun}{role}:{text}".encode("utf-8", "replace"))
        self.begun = True

    def _turn(self, text: str) -> None:
        self._put("assistant" if self.end == USER else "user", text)
        self.end = _after_turn(self.end)

    def piece(self, text: str) -> None:
        self.audit.append(text.replace(",", ""))
        self.waiting = text.split(",")[::-1]

    def row(self, role: str, text: str) -> None:
        done = self.waiting.pop()
        for _ in range(len(done) - 1):
            self._turn("")
        if done[-1] == "R":
            self._turn(text)
        elif done[-1] == "K":
            self._put(role, text)
            self.end = SYSTEM if self.end == NONE and role[:1] == "s" else _after_turn(self.end)

    def result(self) -> tuple:
        for _ in range(len(self.waiting.pop())):
            self._turn("")
        return (*self.head, "".join(self.audit), self.sha.hexdigest())


def repair(
    spark: SparkSession, df: DataFrame, damage: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Per conversation: (id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256), of rows as they are or after the damage."""
    bounded_batches(spark)
    rows = (damaged if damage else undamaged)(df, conv_col, turn_col, role_col, text_col)
    told = materialize(spark, faults(rows))
    found = materialize(spark, edits(signatures(told)))
    nothing = [F.lit(None).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    # the edits of a piece stand before its rows: places count from one
    pieces = found.select("conv", (F.col("part") * PIECE).alias("at"), F.lit(1).alias("edit"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.lit("").alias("role"), F.col("edits").alias("body"))
    lines = told.where(~F.col("gone")).select("conv", F.col("place").alias("at"), F.lit(0).alias("edit"), *nothing, "role", F.col("text").alias("body"))
    dealt = lines.unionByName(pieces).repartition("conv").sortWithinPartitions("conv", "at", "edit")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Repaired | None = None
        names = ["conv", *counts, "audit", "repaired_sha256"]
        for pdf in it:
            out = []
            for conv, at, edit, role, body, *numbers in zip(*(pdf[c] for c in ("conv", "at", "edit", "role", "body", *counts)), strict=True):
                if edit and at == 0:
                    if now is not None:
                        out.append(now.result())
                    now = _Repaired((conv, *map(int, numbers)))
                if edit:
                    now.piece(body)
                else:
                    now.row(role, body)
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([now.result()], columns=names)

    out = dealt.mapInPandas(run, f"conv string, {_COUNTS}, cost long, audit string, repaired_sha256 string")
    return as_before(out.withColumnRenamed("conv", conv_col), df, conv_col)
