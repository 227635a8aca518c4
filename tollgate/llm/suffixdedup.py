"""Exact removal of repeated byte strings with suffix arrays built by linear grouping.

A byte goes if some string of `length` bytes over it starts at another place too, in any
document. Suffix arrays of a corpus don't fit a task, so strings meet by content:

1. Every window of `length` bytes names an anchor, the least hash of its GRAM-byte strings
   (the first, of equal ones). Equal windows name equal anchors at equal offsets. Windows of
   one anchor start side by side; the bytes they span are its region.
2. Anchors are counted by (anchor, region). Regions that occur twice go whole, without
   another look at them; an anchor with one region and one place is unique.
3. One region of each kind of a mixed anchor goes to its anchor's group. There the regions,
   as blocks of BLOCK bytes laid out from the anchor, form one sequence; its suffix array
   (gsaca.py) puts places next to one another that share all whole blocks of a window, and
   those windows are compared byte by byte.
   A group of over MOST regions is counted by hashed windows instead, which needs no task
   to hold the group; that way is exact as well, up to collisions of 128 bits.

Counts are aggregated before they are shuffled; nothing is collected by a hot key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, drop_cut, table
from .gsaca import suffix_array

#: MOST regions of under 353 bytes are 2 MB of text and 85,000 blocks: a task holds them with ease.
LENGTH, GRAM, BLOCK, MOST, BATCH = 200, 48, 20, 5000, 20_000
_TABLE = np.random.default_rng(8).integers(0, 2**64, 256, dtype=np.uint64)
_M = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 22  # bytes that are hashed at once
KEY = ("id", "h")
ANCHORS = "id long, h long, s long, n int, a int, gram long, region binary"


def _gram_hash(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-byte string, put together from strings of powers of two."""
    power, have, out, at = _TABLE[b], 1, None, 0
    while True:
        if k & have:
            if out is None:
                out, at = power.copy(), have
            else:
                m = min(len(out), len(power) - at)
                out = out[:m] * np.uint64(pow(_M, have, 1 << 64)) + power[at:at + m]
                at += have
        have *= 2
        if have > k:
            break
        power = power[:-(have // 2)] * np.uint64(pow(_M, have // 2, 1 << 64)) + power[have // 2:]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(first window start, windows, anchor's offset from it) of each anchor, in order."""
    w = length - gram + 1
    for lo in range(0, max(len(data) - length + 1, 0), _STEP):
        b = np.frombuffer(data, np.uint8)[lo:lo + _STEP + length - 1]
        h = _gram_hash(b, gram)
        key = h >> np.uint64(24) << np.uint64(24) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while have * 2 <= w:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if w > have:
            key = np.minimum(key[:len(key) - (w - have)], key[w - have:])
        at = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        for s, e in zip(first.tolist(), np.r_[first[1:], len(at)].tolist()):
            yield lo + s, e - s, int(at[s]) - s


def _scan(length: int, gram: int):
    def run(frames):
        for f in frames:
            rows = []
            for i, h, t in zip(f["id"], f["h"], f["text"]):
                data = (t or "").encode("utf-8", "surrogatepass")
                for s, n, a in anchors(data, length, gram):
                    rows.append((i, h, s, n, a, xxhash.xxh3_64_intdigest(data[s + a:s + a + gram]) - 2**63, xxhash.xxh3_128_digest(data[s:s + n - 1 + length])))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=[x.split()[0] for x in ANCHORS.split(", ")])
                    rows = []
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ANCHORS.split(", ")])
    return run


def _lcp(t: list[int], sa: list[int]) -> list[int]:
    rank = [0] * len(t)
    for r, i in enumerate(sa):
        rank[i] = r
    out, k = [0] * len(t), 0
    for i in range(len(t)):
        if rank[i]:
            j = sa[rank[i] - 1]
            while i + k < len(t) and j + k < len(t) and t[i + k] == t[j + k]:
                k += 1
            out[rank[i]] = k
            k = max(k - 1, 0)
        else:
            k = 0
    return out


def shared_windows(regions: list[tuple[int, int, bytes]], length: int, block: int = BLOCK) -> list[np.ndarray]:
    """For regions (group, anchor's offset, bytes): which of each one's window starts also stand in another of its group."""
    marks = [np.zeros(len(d) - length + 1, bool) for _, _, d in regions]
    names: dict = {}
    text, owner, end = [], [], 1
    for n, (g, a, d) in enumerate(regions):
        r = a % block
        for lo in range(r, len(d) - block + 1, block):
            text.append(names.setdefault((g, lo - a, d[lo:lo + block]), len(names) + len(regions) + 1))
            owner.append((n, lo))
        text.append(end)  # an end of its own, below all blocks
        owner.append((n, -1))
        end += 1
    need = max((length - block + 1) // block, 1)
    sa = suffix_array(text)
    lcp = _lcp(text, sa)
    r = 0
    while r < len(sa):
        e = r + 1
        while e < len(sa) and lcp[e] >= need:
            e += 1
        if e - r > 1:
            seen: dict[bytes, tuple[int, int]] = {}
            for i in sa[r:e]:
                n, lo = owner[i]
                d, m = regions[n][2], marks[n]
                for p in range(max(lo - block + 1, 0), min(lo + 1, len(m))):
                    x = d[p:p + length]
                    first = seen.setdefault(x, (n, p))
                    if first != (n, p):
                        m[p] = True
                        marks[first[0]][first[1]] = True
        r = e
    return marks


def _runs(mark: np.ndarray):
    edge = np.flatnonzero(np.diff(np.r_[False, mark, False].astype(np.int8)))
    return zip(edge[::2].tolist(), edge[1::2].tolist())


def _compare(length: int):
    def run(frames):
        rows, size = [], 0

        def flush():
            got = shared_windows([(g, a, d) for _, _, _, g, a, d in rows], length)
            out = [(i, h, s + x, s + y - 1 + length) for (i, h, s, *_), m in zip(rows, got) for x, y in _runs(m)]
            return pd.DataFrame(out, columns=["id", "h", "lo", "hi"])

        for f in frames:  # sorted by anchor
            for i, h, s, g, a, d in zip(f["id"], f["h"], f["s"], f["gram"], f["a"], f["bytes"]):
                if size > BATCH and rows[-1][3] != g:
                    yield flush()
                    rows, size = [], 0
                rows.append((i, h, s, g, a, d))
                size += len(d) // BLOCK + 1
        if rows:
            yield flush()
    return run


def _windows(length: int):
    def run(frames):
        for f in frames:
            for i, h, s, g, a, d in zip(f["id"], f["h"], f["s"], f["gram"], f["a"], f["bytes"]):
                yield pd.DataFrame([(i, h, s + p, xxhash.xxh3_128_digest(d[p:p + length])) for p in range(len(d) - length + 1)], columns=["id", "h", "p", "w"])
    return run


def _apply(f_text: str, spans) -> tuple[bytes, int, int, int]:
    data = (f_text or "").encode("utf-8", "surrogatepass")
    kept, at, gone, n = [], 0, 0, 0
    last = -1
    for lo, hi in sorted(spans):
        if lo > last:
            n += 1
            kept.append(data[at:lo])
            gone += hi - lo
            at = last = hi
        elif hi > last:
            gone += hi - last
            at = last = hi
    kept.append(data[at:])
    return b"".join(kept), len(data), gone, n


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, gram: int = GRAM, finish=None, out="kept binary") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the bytes kept (or finish of them, under the name and type of out).

    Null texts count as empty; texts of under `length` bytes keep everything. Rows that repeat
    an id and text are places of their own, so both lose all they share. Null ids are kept. Texts
    may be of any length: a task holds one text at a time, and repeats within it count too. An
    empty table gives no rows; other columns are not read.
    """
    if not gram <= length or length - gram + 1 > 1 << 20:
        raise ValueError("gram must be at most length")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    found = cut(keyed.select("id", "h", "text").mapInPandas(_scan(length, gram), ANCHORS), "anchors")
    kinds = cut(found.groupBy("gram", "region").agg(F.count("*").alias("c"), F.min(F.struct("id", "h", "s", "n", "a")).alias("one")), "regions")
    mixed = kinds.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1")
    # Regions that stand twice go whole.
    whole = found.join(kinds.where("c > 1").select("gram", "region"), ["gram", "region"], "left_semi").select("id", "h", F.col("s").alias("lo"), (F.col("s") + F.col("n") - 1 + length).alias("hi"))
    # One region of each kind of a mixed anchor, with its bytes.
    todo = cut(kinds.join(mixed, "gram").select("gram", "k", "one.*"), "mixed")
    where_ = todo.groupBy("id", "h").agg(F.collect_list(F.struct("gram", "k", "s", "n", "a")).alias("x"))  # at most one text's anchors
    cutout = keyed.join(where_, list(KEY)).dropDuplicates(["id", "h"]).select("id", "h", F.encode("text", "UTF-8").alias("b"), F.explode("x").alias("x"))
    cutout = cut(cutout.select("id", "h", "x.*", F.expr(f"substring(b, cast(x.s + 1 as int), cast(x.n - 1 + {length} as int))").alias("bytes")), "bytes")
    usual = cutout.where(F.col("k") <= MOST).select("id", "h", "s", "gram", "a", "bytes")
    near = usual.repartition("gram").sortWithinPartitions("gram").mapInPandas(_compare(length), "id long, h long, lo long, hi long")
    wide = cutout.where(F.col("k") > MOST).select("id", "h", "s", "gram", "a", "bytes").mapInPandas(_windows(length), "id long, h long, p long, w binary")
    twice = wide.groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    wide = wide.join(twice, "w", "left_semi").select("id", "h", F.col("p").alias("lo"), (F.col("p") + length).alias("hi"))
    spans = cut(whole.unionByName(near).unionByName(wide), "spans")
    for done in (found, kinds, todo, cutout):
        drop_cut(done)
    # A text's spans, runs of them merged before they meet the text.
    w = Window.partitionBy("id", "h").orderBy("lo", "hi")
    ends = spans.withColumn("before", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    runs = ends.withColumn("run", F.sum((F.col("before").isNull() | (F.col("before") < F.col("lo"))).cast("int")).over(w)).groupBy("id", "h", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    per = runs.groupBy("id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    name = out.split()[0]

    def run(frames):
        for f in frames:
            rows = []
            for i, t, sp in zip(f["doc_id"], f["text"], f["spans"]):
                kept, n, gone, k = _apply(t, [(x["lo"], x["hi"]) for x in sp] if sp is not None else [])
                rows.append((i, n, gone, k, kept if finish is None else finish(kept)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", name]).astype({"doc_id": "Int64"})

    return keyed.join(per, list(KEY), "left").select("doc_id", "text", "spans").mapInPandas(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {out}")


def _sha256(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def op8_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), finish=_sha256, out="kept_sha256 string")


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLES: dict = {}
