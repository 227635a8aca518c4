"""Packing by cutting-stock column generation.

Documents are cut at every `room` ids; what remains is rounded up to bins of `grain` ids,
and the histogram of bins (at most room / grain + SHORT rows, whatever the corpus) is all that
the driver sees. Pieces of at most SHORT ids, which rounding would swell, keep their exact
lengths as bins: patterns of them fill cartons of at most CARTON ids, and a carton is one more
piece of the sequences. A linear program over patterns (how many pieces of each bin one sequence
takes) is solved by a revised simplex; a knapsack dynamic program over the duals prices new
columns. Patterns are rounded down, what demand is left is packed by repeating the
knapsack's best pattern over it, and pieces, ranked within their bin, take the slots.

Ranks come from counts by (bin, salt), with about SALT_ROWS pieces a salt, so a bin that
holds a third of all pieces is ranked by many tasks.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, drop_cut, table
from .tokenbin import with_ids

ROOM, GRAIN, SALT_ROWS = 4096, 16, 20_000
#: Longest pieces that go into cartons, and a carton's ids.
SHORT, CARTON = 64, 1024
#: How far prices are drawn to those of the best bound.
DRAWN = 0.9


def knapsack(value: np.ndarray, size: np.ndarray, room: int, most: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Best total value in room by dynamic programming, and how many of each item; most bounds them."""
    items = [i for i in range(len(size)) if value[i] > 1e-12 and (most is None or most[i] > 0)]
    if most is None:
        best, pick = np.zeros(room + 1), np.full(room + 1, -1)
        order = np.array(items, int)[np.argsort(size[items], kind="stable")]
        sizes, values = size[order], value[order]
        ends = np.searchsorted(sizes, np.arange(room + 1), side="right")
        for r in range(1, room + 1):
            best[r] = best[r - 1]
            if ends[r]:
                c = best[r - sizes[:ends[r]]] + values[:ends[r]]
                j = int(c.argmax())
                if c[j] > best[r] + 1e-12:
                    best[r], pick[r] = c[j], order[j]
        count, r = np.zeros(len(size), int), room
        while r > 0:
            if pick[r] < 0:
                r -= 1
            else:
                count[pick[r]] += 1
                r -= size[pick[r]]
        return float(best[room]), count
    # Bounded: powers of two of every item, each taken at most once.
    best, rows = np.zeros(room + 1), []
    for i in items:
        left, n = int(min(most[i], room // size[i])), 1
        while left > 0:
            k = min(n, left)
            w, v = k * int(size[i]), k * value[i]
            if w <= room:
                new = best.copy()
                new[w:] = np.maximum(best[w:], best[:-w] + v)
                rows.append((i, k, w, new > best + 1e-12))
                best = new
            left, n = left - k, n * 2
    count, r = np.zeros(len(size), int), room
    for i, k, w, took in reversed(rows):
        if took[r]:
            count[i] += k
            r -= w
    return float(best[room]), count


def patterns(demand: np.ndarray, size: np.ndarray, room: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is cut, covering exactly the demand."""
    use = np.flatnonzero(demand > 0)
    if not len(use):
        return []
    d, s = demand[use].astype(float), size[use]
    a = np.diag(np.maximum(room // s, 1)).astype(float)  # starting basis: one size a pattern
    inv = np.linalg.inv(a)
    # Prices are drawn towards those of the best bound so far, as the basis' own swing widely.
    bound, centre = 0.0, np.zeros(len(s))
    for step in range(rounds):
        dual, x = inv.sum(axis=0), inv @ d  # every pattern costs one sequence
        least = max(bound, float(s @ d) / room)
        if x.sum() <= max(np.ceil(least - 1e-6), least * (1 + 1e-5)):
            break
        for share in (DRAWN, 0.0) if bound else (0.0,):
            price = np.maximum(share * centre + (1 - share) * dual, 0)
            value, col = knapsack(price, s, room)
            if price @ d / value > bound:  # prices over their best pattern's give a lower bound
                bound, centre = float(price @ d / value), price / value
            if dual @ col > 1 + 1e-7:
                break
        else:
            break
        y = inv @ col
        up = np.flatnonzero(y > 1e-9)
        j = int(up[np.argmin(x[up] / y[up])])
        a[:, j] = col
        if step % 50 == 49:
            inv = np.linalg.inv(a)
        else:  # a rank-one change of the basis
            row = inv[j] / y[j]
            inv = inv - np.outer(y, row)
            inv[j] = row
    else:
        warnings.warn(f"column generation stopped after {rounds} rounds; the packing covers the demand but may need more sequences")
    times = np.floor(np.maximum(np.linalg.solve(a, d), 0) + 1e-9).astype(int)
    left, out = d.astype(int), []
    for j in np.argsort(-times, kind="stable"):
        col = a[:, j].astype(int)
        n = int(min([times[j], *(left[col > 0] // col[col > 0])]))
        if n > 0:
            out.append((col, n))
            left = left - n * col
    while left.any():
        _, col = knapsack(s * (1 + s / room), s, room, left)  # large pieces first
        n = int(min(left[col > 0] // col[col > 0]))
        out.append((col, n))
        left = left - n * col
    full = []
    for col, n in out:
        c = np.zeros(len(size), int)
        c[use] = col
        full.append((c, n))
    return full


def _slots(plan: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """Slots of each bin in rank order: from, pieces a sequence, first sequence, slot there."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    first, filled = 0, {}
    for col, times in plan:
        at = 0
        for b in sorted(np.flatnonzero(col) + 1, reverse=True):
            k = int(col[b - 1])
            slots.setdefault(int(b), []).append((filled.get(b, 0), k, first, at))
            filled[b] = filled.get(b, 0) + k * times
            at += k
        first += times
    return {b: np.array(v, dtype=np.int64) for b, v in slots.items()}


def _look_up(slots: dict[int, np.ndarray], b: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and slot of the pieces of these bins and ranks."""
    sequence, slot = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
    for x in np.unique(b):
        m = b == x
        t = slots[int(x)]
        row = t[np.searchsorted(t[:, 0], rank[m], side="right") - 1]
        k = rank[m] - row[:, 0]
        sequence[m], slot[m] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1]
    return sequence, slot


def pieces(docs: DataFrame, tokenizer: str, end_id: int | None, room: int = ROOM, id_col="doc_id", text_col="text") -> DataFrame:
    """Whole texts' ids cut at every room ids: doc_id, start, length, doc_tokens, ids (binary).

    Null and empty texts have the end id alone (nothing without one). Null and repeated ids are
    kept as they are. A text of any length is encoded whole in one task; its pieces are rows. An
    empty table gives no rows; other columns are not read.
    """
    def cut_up(i, ids):
        n = len(ids) // 4
        return [(i, lo, min(room, n - lo), n, ids[4 * lo:4 * min(n, lo + room)]) for lo in range(0, n, room)]

    return with_ids(docs, tokenizer, end_id, id_col, text_col, finish=cut_up, schema="doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(found: DataFrame, room: int = ROOM, grain: int = GRAIN) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, start and length (1 to room).

    Sequences are numbered by pattern and occurrence from 0; offsets within one are gapless
    from 0, larger bins first. Rows that repeat an id are packed as rows of their own.
    Equal (doc_id, start) are ordered by a hash of the whole row. An empty table gives no rows.
    Columns named sequence_id or offset, or those that the work needs, are refused.
    """
    if clash := {"sequence_id", "offset", "bin_", "salt_", "rank_", "base_", "at_", "slot_"} & set(found.columns):
        raise ValueError(f"columns {sorted(clash)} are needed here")
    if room % grain:
        raise ValueError("grain must divide room")
    short, carton = min(SHORT, room), min(CARTON, room)
    # Bins of short pieces are their lengths below zero, those of the others are grains.
    size = F.col("length")
    named = found.withColumn("bin_", F.when(size <= short, -size).otherwise(F.ceil(size / grain)).cast("int"))
    named = cut(named, "pieces")
    n = named.count()
    salts = max(1, -(-n // SALT_ROWS))
    named = named.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    hist = {r["bin_"]: r["n"] for r in named.groupBy("bin_").agg(F.count("*").alias("n")).collect()}  # at most room / grain + SHORT rows
    inner = patterns(np.array([hist.get(-b, 0) for b in range(1, short + 1)]), np.arange(1, short + 1), carton)
    demand = np.array([hist.get(b, 0) for b in range(1, room // grain + 1)])
    cartons = []  # of each inner pattern: bin, and rank there of its first carton, behind the pieces
    for col, times in inner:
        b = -(-int(col @ np.arange(1, short + 1)) // grain)
        cartons.append((b, int(demand[b - 1])))
        demand[b - 1] += times
    outer = _slots(patterns(demand, np.arange(1, room // grain + 1), room // grain))  # in grains
    boxes = _slots(inner)
    kinds = np.array(cartons, np.int64).reshape(-1, 2)
    begins = np.cumsum([0, *(times for _, times in inner)])
    per = named.groupBy("bin_", "salt_").agg(F.count("*").alias("n"))
    per = per.withColumn("base_", F.sum("n").over(Window.partitionBy("bin_").orderBy("salt_").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n")
    ranked = named.withColumn("rank_", F.row_number().over(Window.partitionBy("bin_", "salt_").orderBy("doc_id", "start", F.xxhash64(*found.columns))) - 1)
    ranked = ranked.join(per, ["bin_", "salt_"]).withColumn("rank_", F.col("rank_") + F.col("base_"))

    @F.pandas_udf("sequence_id long, slot long, inner long")
    def place(b: pd.Series, rank: pd.Series) -> pd.DataFrame:
        b, rank = b.to_numpy().copy(), rank.to_numpy().copy()
        within = np.zeros(len(b), np.int64)
        if (small := np.flatnonzero(b < 0)).size:
            box, within[small] = _look_up(boxes, -b[small], rank[small])
            kind = np.searchsorted(begins, box, side="right") - 1
            b[small], rank[small] = kinds[kind, 0], kinds[kind, 1] + box - begins[kind]
        sequence, slot = _look_up(outer, b, rank)
        return pd.DataFrame({"sequence_id": sequence, "slot": slot, "inner": within})

    got = ranked.withColumn("at_", place("bin_", "rank_")).select(*found.columns, F.col("at_.sequence_id").alias("sequence_id"), F.struct("at_.slot", "at_.inner").alias("slot_"))
    w = Window.partitionBy("sequence_id").orderBy("slot_").rowsBetween(Window.unboundedPreceding, -1)
    return got.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0))).drop("slot_")


def op10_packing(spark, sf_dir, tokenizer: str | None = None, end_id: int = 2):
    import public_tokenizers

    got = pieces(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id)
    # Only the digest of the ids goes on; the operator packs any columns that come along.
    got = got.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(got).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict = {}
