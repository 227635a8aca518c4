"""Benchmark decontamination by pigeonhole edit matching.

Item and text are lowered and every run of other characters than letters and digits
becomes one space. An item of n characters may differ by k = floor(n * errors) edits; of
any k + 1 pieces of it one then stands unchanged. All pieces go into one Aho-Corasick
automaton; each hit fixes where the item would lie, and Myers' bit-parallel algorithm gives
the least edit distance of the whole item to any stretch there.

Items go in groups of a fixed number of characters, one pass each, so what is broadcast
and indexed has a fixed bound (one item of more is a group of its own).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, held, table

#: Share of an item's characters that may differ; items this short must stand exactly, between word ends.
ERRORS, SHORT = 0.05, 20
#: Characters of items in one pass.
GROUP_CHARS = 8 << 20
_OTHER = re.compile(r"[\W_]+")
LEAKS = "array<struct<item_id:long,distance:int,start:int,end:int>>"


def plain(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def split_item(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces with their offsets, sizes as equal as can be."""
    n = len(item)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of item to a stretch of text, and where the first such stretch ends."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


def budget(item: str, errors: float = ERRORS) -> int:
    return 0 if len(item) < SHORT else int(len(item) * errors)


class Index:
    """Automaton over the pieces of items: (id, plain text)."""

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS):
        import ahocorasick

        self.items, found = items, {}
        for n, (_, item) in enumerate(items):
            for off, piece in split_item(item, budget(item, errors)):
                found.setdefault(piece, []).append((n, off))
        self.budgets = [budget(x, errors) for _, x in items]
        self.auto = ahocorasick.Automaton()
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        if found:
            self.auto.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(id, distance, start, end) of each item's best stretch of the plain text."""
        best: dict[int, tuple[int, int, int]] = {}
        done: dict[int, tuple[int, int]] = {}
        for end, (size, where) in self.auto.iter(text) if len(self.auto) else ():
            for n, off in where:
                if n in best and best[n][0] == 0:
                    continue
                item, k = self.items[n][1], self.budgets[n]
                at = end + 1 - size - off
                if 0 <= at and text.startswith(item, at) and (len(item) >= SHORT or (at == 0 or text[at - 1] == " ") and text[at + len(item):at + len(item) + 1] in ("", " ")):
                    best[n] = (0, at, at + len(item))
                    continue
                # A stretch within k of `at` starts by at + k; searching 3 k further covers hits up to at + k.
                seen = done.get(n, (1, 0))
                if k == 0 or seen[0] <= at <= seen[1]:
                    continue
                lo = max(0, at - k)
                hi = min(len(text), at + len(item) + 3 * k)
                done[n] = (at, at + k)
                d, to = myers(item, text[lo:hi])
                if d <= k and (n not in best or d < best[n][0]):
                    d2, back = myers(item[::-1], text[lo:lo + to][::-1])
                    best[n] = (d, lo + to - back, lo + to)
        return [(self.items[n][0], *v) for n, v in sorted(best.items())]


def leaks(docs: DataFrame, text: Column, items: list[tuple[int, str]], errors: float = ERRORS) -> Column:
    """Column of LEAKS for items of (id, plain text), a bounded group of them: broadcast once, indexed once a worker."""
    key, sent = hash((tuple(items), errors)), docs.sparkSession.sparkContext.broadcast(items)

    @F.pandas_udf(LEAKS)
    def search(t: pd.Series) -> pd.Series:
        x = held(("items", key), lambda: Index(sent.value, errors))
        return pd.Series([[dict(zip(("item_id", "distance", "start", "end"), r)) for r in x.search(plain(s))] for s in t])

    return search(text)


def mark(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, text_col="text", out="leaks") -> DataFrame:
    """docs with one more column: the items found in each row's whole text, by item id.

    Positions are those of the plain text; of several stretches of one distance the first
    found is told. Null or empty texts and items match nothing; items with a null id are left
    out; repeated items of one id and text count once. A text of any length is searched whole
    in one task. out must be no column of docs. Beyond GROUP_CHARS of items there is a pass for
    each group, written between, so driver and workers hold one group at a time.
    """
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null").distinct()
    got, group, size = docs.withColumn(out, F.array().cast(LEAKS)), [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if not (x := plain(r["text"])):
            continue
        if size + len(x) > GROUP_CHARS and group:
            got = cut(_more(got, text_col, out, group, errors), "leaks")
            group, size = [], 0
        group.append((r["item_id"], x))
        size += len(x)
    return _more(got, text_col, out, group, errors) if group else got


def _more(docs: DataFrame, text_col: str, out: str, group, errors: float) -> DataFrame:
    return docs.withColumn(out, F.concat(out, leaks(docs, F.col(text_col), group, errors)))


def op5_decontaminate(spark, sf_dir):
    """One row per document and item found in it: doc_id, item_id, distance, start, end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = mark(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("x"))
    return got.select("doc_id", "x.item_id", "x.distance", "x.start", "x.end")


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES: dict = {}
