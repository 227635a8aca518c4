"""Phrase collocations by depth-limited count tries.

Each task builds, over blocks of words, the trie of all windows of up to five words below their
language, serialises it sorted and front-coded, and cuts it at bounds that all tasks share. The
tries' pieces of one prefix range meet in one task, which merges them. Walks down the merged trie
give every phrase's left parts; right parts are suffix links, followed by a join. A node that a
bound may cut is summed over the ranges that hold it, so counts are exact wherever bounds lie.
"""

from __future__ import annotations

import json
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, drop_cut, table

#: Words of a phrase at most, words of a task's block, rows that a merging task gathers before it merges them.
DEPTH, BLOCK_WORDS, MERGE_ROWS = 5, 1 << 20, 1 << 20
#: Text bytes that a prefix range stands for, bounds at most, and sampled windows a range that bounds come from.
RANGE_BYTES, MOST_BOUNDS, SAMPLES = 4 << 20, 1 << 20, 32
# What ends a piece of words.
_ENDS = b".,;:!?\n\v\f\r"
_PLAIN = bytes.maketrans(_ENDS + b"\t", b"." * len(_ENDS) + b" ")
PIECES = "rng int, langs string, words binary, grams binary"
NODES = "lang string, words int, phrase string, f long, lefts array<long>, edge boolean"


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with b"." where a piece ends."""
    return text.lower().translate(_PLAIN).replace(b".", b" . ").split()


class _Ids(dict):
    def __missing__(self, w):
        self[w] = out = len(self)
        return out


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


def _sorted(grams: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and their counts. Columns are packed into as few sort keys as 63 bits allow."""
    keys, key, used = [], None, 0
    for j in range(grams.shape[1]):
        col, b = grams[:, j].astype("i8"), _bits(grams[:, j].max(initial=0))
        if key is not None and used + b <= 63:
            key, used = (key << b) | col, used + b
        else:
            if key is not None:
                keys.append(key)
            key, used = col, b
    keys.append(key)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    n = np.diff(np.append(starts, len(order))) if counts is None else np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]
    return grams[order[starts]], n.astype("i8")


def encode(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted trie in depth-first order: how many columns each row shares with the one before, and the rest."""
    same = np.zeros(grams.shape, bool)
    same[1:] = np.cumprod(grams[1:] == grams[:-1], 1, dtype="i1").astype(bool)
    shared, size = same.sum(1), (grams > 0).sum(1) + (grams[:, 0] == 0)  # column 0 is the language, from 0 on
    at = np.arange(grams.shape[1])
    rest = grams[(at >= shared[:, None]) & (at < size[:, None])]
    wide = "<u2" if rest.max(initial=0) < 1 << 16 else "<u4"
    head = np.array([len(grams), len(rest), wide == "<u4"], "<i8").tobytes()
    return zstandard.compress(head + (shared * 8 + size).astype("u1").tobytes() + rest.astype(wide).tobytes() + counts.astype("<i8").view("u1").reshape(-1, 8).T.tobytes(), 1)


def decode(data: bytes, width: int = DEPTH + 1) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(data)
    n, m, wide = np.frombuffer(raw, "<i8", 3).tolist()
    code = np.frombuffer(raw, "u1", n, 24)
    rest = np.frombuffer(raw, "<u4" if wide else "<u2", m, 24 + n)
    counts = np.ascontiguousarray(np.frombuffer(raw, "u1", 8 * n, 24 + n + m * (4 if wide else 2)).reshape(8, n).T).view("<i8").ravel()
    shared, size, at = code // 8, code % 8, np.arange(width)
    out = np.zeros((n, width), "i4")
    own = (at >= shared[:, None]) & (at < size[:, None])
    out[own] = rest
    for j in range(width):  # a shared column is the last row's that has its own
        row = np.maximum.accumulate(np.where(j < shared, 0, np.arange(n)))
        out[:, j] = out[row, j]
    return out, counts


def _windows(ids: np.ndarray, langs: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(language, word, next words while the piece lasts) of every word; 0 ends a piece."""
    n = len(ids)
    more = np.concatenate([ids, np.zeros(DEPTH, ids.dtype)])
    cols = [ids]
    for k in range(1, DEPTH):
        cols.append(more[k:n + k] * (cols[-1] > 0))
    return np.stack([langs, *cols], 1)[start & (ids > 0)]


class _Block:
    """Words of one task until there are BLOCK_WORDS; languages and words numbered as they come."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.words, self.langs, self.parts, self.size = _Ids({b".": 0}), _Ids(), [], 0

    def add(self, lang: bytes, words: list[bytes]):
        """Yields after each full block. A long text goes in slices, each with the words that its windows look ahead."""
        for s in range(0, len(words), BLOCK_WORDS):
            part = words[s:s + BLOCK_WORDS + DEPTH - 1]
            n = min(BLOCK_WORDS, len(words) - s)
            self.parts.append((np.fromiter(map(self.words.__getitem__, part), "i4", len(part)), self.langs[lang], n))
            self.size += n
            if self.size >= BLOCK_WORDS:
                yield

    def trie(self):
        """Sorted languages, sorted words (numbered from 1), windows, counts; the block is empty then."""
        ids = np.concatenate([x for p, _, _ in self.parts for x in (p, np.zeros(1, "i4"))])
        langs = np.repeat(np.array([g for _, g, _ in self.parts], "i4"), [len(p) + 1 for p, _, _ in self.parts])
        start = np.concatenate([np.arange(len(p) + 1) < n for p, _, n in self.parts])
        words, names = list(self.words)[1:], list(self.langs)
        self.clear()
        by, by_lang = sorted(range(len(words)), key=words.__getitem__), sorted(range(len(names)), key=names.__getitem__)
        rank, rank_lang = np.zeros(len(words) + 1, "i4"), np.zeros(len(names), "i4")
        rank[np.array(by, "i8") + 1] = np.arange(1, len(words) + 1)
        rank_lang[by_lang] = np.arange(len(names))
        grams, counts = _sorted(_windows(rank[ids], rank_lang[langs], start), None)
        return [names[i] for i in by_lang], [words[i] for i in by], grams, counts


def _first(langs, words, cols, bound) -> int:
    """The first of the sorted rows (given as columns) that is not below bound, a tuple of language and words."""
    lo, hi = 0, cols.shape[1]
    for j, w in enumerate(bound):
        if j and not w:
            break
        names = words if j else langs
        i = bisect_left(names, w)
        found = i < len(names) and names[i] == w
        i += j > 0
        col = cols[j, lo:hi]
        if not found:
            return lo + int(np.searchsorted(col, i))
        lo, hi = lo + int(np.searchsorted(col, i)), lo + int(np.searchsorted(col, i, "right"))
    return lo


def _pieces(langs, words, grams, counts, bounds):
    """Rows of PIECES: the trie cut at the bounds, each piece with the words that it uses."""
    cols = np.ascontiguousarray(grams.T)
    at = [0, *(_first(langs, words, cols, b) for b in bounds), len(grams)]
    del cols
    for r, (lo, hi) in enumerate(zip(at, at[1:])):
        if lo < hi:
            g = grams[lo:hi].copy()
            lookup, used_langs = np.zeros(len(words) + 1, "i4"), np.unique(g[:, 0])
            lookup[g[:, 1:].ravel()] = 1
            lookup[0] = 0
            used = np.flatnonzero(lookup)
            lookup[used] = np.arange(1, len(used) + 1)
            g[:, 1:] = lookup[g[:, 1:]]
            g[:, 0] = np.searchsorted(used_langs, g[:, 0])
            yield r, json.dumps([langs[i].decode() for i in used_langs]), zstandard.compress(b" ".join([words[i - 1] for i in used]), 1), encode(g, counts[lo:hi])


def _merged(tries):
    """One trie of several (languages, words, grams, counts)."""
    langs, words = sorted({x for t in tries for x in t[0]}), sorted({x for t in tries for x in t[1]})
    lang_at, word_at = {x: i for i, x in enumerate(langs)}, {x: i for i, x in enumerate(words, 1)}
    rows = []
    for a, b, g, _ in tries:
        out = np.empty_like(g)
        out[:, 0] = np.fromiter(map(lang_at.__getitem__, a), "i4", len(a))[g[:, 0]]
        out[:, 1:] = np.concatenate([np.zeros(1, "i4"), np.fromiter(map(word_at.__getitem__, b), "i4", len(b))])[g[:, 1:]]
        rows.append(out)
    return langs, words, *_sorted(np.concatenate(rows), np.concatenate([t[3] for t in tries]))


def _nodes(langs, words, grams, counts, least: int):
    """Nodes of a merged trie with `least` occurrences, and all that the range's bounds may cut (edge).

    The walk down gives the counts of each node's ancestors, -1 for those at an edge.
    """
    first, total, cols = [], [], {k: [] for k in ("lang", "words", "phrase", "f", "lefts", "edge")}
    new, group = np.zeros(len(grams), bool), []
    new[0] = True
    for d in range(grams.shape[1]):
        new[1:] |= grams[1:, d] != grams[:-1, d]
        starts = np.flatnonzero(new)
        first.append(starts)
        group.append(np.cumsum(new) - 1)
        total.append(np.add.reduceat(counts, starts))
        edge = np.zeros(len(starts), bool)
        edge[[0, -1]] = True
        real = (grams[starts, d] > 0) | (d == 0)
        for i in np.flatnonzero(real & (edge | (total[d] >= least) | (d == 0))).tolist():
            row = first[d][i]
            lefts = []
            for k in range(d):
                g = group[k][row]
                lefts.append(-1 if g in (0, len(first[k]) - 1) else int(total[k][g]))
            cols["lang"].append(langs[grams[row, 0]])
            cols["words"].append(d)
            cols["phrase"].append(b" ".join([words[w - 1] for w in grams[row, 1:d + 1]]).decode())
            cols["f"].append(int(total[d][i]))
            cols["lefts"].append(lefts)
            cols["edge"].append(bool(edge[i]))
    return pa.record_batch([pa.array(cols["lang"], "string"), pa.array(cols["words"], "int32"), pa.array(cols["phrase"], "string"), pa.array(cols["f"], "int64"),
                            pa.array(cols["lefts"], pa.list_(pa.int64())), pa.array(cols["edge"], "bool")], names=list(cols))


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).cast("binary").alias("lang"), F.col(text_col).cast("binary").alias("text")).where("text is not null")


def range_bounds(texts: DataFrame) -> list[tuple]:
    """Bounds of prefix ranges that hold about RANGE_BYTES of text each, from windows sampled at even steps.

    They decide only how the work is dealt. At most MOST_BOUNDS, so what tasks are sent is bounded. However many
    partitions texts or samples lie in, they are as many: steps begin anywhere, and every SAMPLES-th sample of all counts.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per = max(RANGE_BYTES, -(-size // MOST_BOUNDS))
    step = per // SAMPLES
    if size <= per:
        return []
    names = ["lang", *(f"w{i}" for i in range(DEPTH))]

    def sample(batches):
        rest = int(step * (0.618034 * (TaskContext.get().partitionId() + 0.5) % 1))  # a partition may be shorter than a step
        for b in batches:
            rows = []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                while rest < len(text):
                    part = tokens(text[rest:rest + 512])[1:]
                    part = [w for w in part[:DEPTH]]
                    if part and part[0] != b".":
                        part = part[:part.index(b".")] if b"." in part else part
                        rows.append((lang, *part, *[b""] * (DEPTH - len(part))))
                    rest += step
                rest -= len(text)
            yield pa.record_batch([pa.array([r[j] for r in rows], "binary") for j in range(DEPTH + 1)], names=names)

    got = cut(texts.mapInArrow(sample, ", ".join(f"{c} binary" for c in names)), "samples")
    # The number's high part is the partition, the low part a row's place there.
    ranked = cut(got.orderBy(*names).withColumn("at", F.monotonically_increasing_id()), "ranked")
    counts = dict(map(tuple, ranked.groupBy(F.shiftright("at", 33)).count().collect()))
    before, total = {}, 0
    for k in sorted(counts):
        before[k], total = total, total + counts[k]

    def every(batches):
        for b in batches:
            at = b.column("at").to_pylist()
            yield b.take(pa.array([i for i, x in enumerate(at) if (before[x >> 33] + (x & (1 << 33) - 1)) % SAMPLES == SAMPLES // 2], "int64"))

    out = sorted({tuple(map(bytes, r[:-1])) for r in ranked.mapInArrow(every, ranked.schema).collect()})
    drop_cut(got)
    drop_cut(ranked)
    return out


def trie_nodes(docs: DataFrame, least: int, lang_col="lang", text_col="text") -> DataFrame:
    """NODES: phrases of 0 (the language, f: all its words) to 5 words with f >= least, and some rarer ones at edges."""
    texts = _texts(docs, lang_col, text_col)
    bounds = range_bounds(texts)

    def shards(batches):
        block = _Block()

        def flush():
            if block.size:
                for row in _pieces(*block.trie(), bounds):
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(row, ("int32", "string", "binary", "binary"))], names=["rng", "langs", "words", "grams"])

        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text")):  # one text at a time
                for _ in block.add(lang.as_py(), tokens(text.as_py())):
                    yield from flush()
        yield from flush()
        pa.default_memory_pool().release_unused()  # the worker goes on with other tasks

    def merge(batches):
        at, tries, rows = None, [], 0
        for b in batches:
            for r, langs, words, grams in zip(*(b.column(c).to_pylist() for c in ("rng", "langs", "words", "grams"))):
                if r != at and tries:
                    yield _nodes(*_merged(tries), least)
                    tries, rows = [], 0
                elif rows > max(MERGE_ROWS, 2 * len(tries[0][2]) if tries else 0):
                    tries = [_merged(tries)]
                    rows = len(tries[0][2])
                at = r
                words = zstandard.decompress(words)
                tries.append(([x.encode() for x in json.loads(langs)], words.split(b" ") if words else [], *decode(grams)))
                rows += len(tries[-1][2])
        if tries:
            yield _nodes(*_merged(tries), least)
        pa.default_memory_pool().release_unused()

    cuts = texts.mapInArrow(shards, PIECES).repartitionById(len(bounds) + 1, F.col("rng")).sortWithinPartitions("rng")
    nodes = cut(cuts.mapInArrow(merge, NODES), "trie")
    out = nodes.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"), F.max("lefts").alias("lefts"), F.max("edge").alias("edge"))
    return cut(out.where((F.col("f") >= least) | (F.col("words") == 0) | F.col("edge")), "nodes")


def _part(k, n):
    """n words from the k-th on (from 1) of a phrase."""
    return F.array_join(F.slice(F.split("phrase", " "), k, n), " ")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, percent: int = 100, lang_col="lang", text_col="text", salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to 5 words.

    Words lie between blanks within pieces, A-Z lowered. A phrase with `least` occurrences is cut
    where 1000 * a * n / (l * r), floored, is lowest (ties: after the fewest words). Phrases within a
    longer one that has `percent` of their occurrences are dropped; as a longer phrase is rarer than
    all within it, looking one word further on either side decides that. Ties of rank go to more
    occurrences, then to the phrase in byte order. Null languages are "und", null texts empty, rows
    that repeat count each time; texts may be of any length (a task numbers one block of words at a
    time). Other columns are not read. An empty table gives no rows.
    """
    nodes = trie_nodes(docs, least, lang_col, text_col)
    # At most two nodes a depth and range, of at most MOST_BOUNDS + 1 ranges.
    edges = F.broadcast(nodes.where("edge").select("lang", F.col("phrase").alias("left"), F.col("f").alias("edge_f")))
    some = nodes.where((F.col("words") >= 2) & (F.col("f") >= least)).select("lang", "words", "phrase", F.col("f").alias("a"), F.col("lefts"))
    long = some.where("words >= 3").select("lang", "a", F.explode(F.array(_part(1, F.col("words") - 1), _part(2, F.col("words") - 1))).alias("phrase"))
    within = long.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    some = some.join(within, ["lang", "phrase"], "left").where("longer is null or 100 * longer < {} * a".format(int(percent))).drop("longer")
    # A row for each ancestor: the language's own (k = 0) gives n, the others the left parts.
    walk = some.select("lang", "words", "phrase", "a", F.posexplode("lefts").alias("k", "l")).withColumn("left", _part(1, F.col("k"))).withColumn("right", _part(F.col("k") + 1, F.col("words") - F.col("k")))
    walk = walk.join(edges, ["lang", "left"], "left").withColumn("l", F.when(F.col("l") >= 0, F.col("l")).otherwise(F.col("edge_f"))).drop("edge_f", "left")
    right = nodes.where("words between 1 and {}".format(DEPTH - 1)).select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    links = walk.where("k > 0").join(right, ["lang", "right"])
    both = links.unionByName(walk.where("k = 0").withColumn("r", F.lit(None).cast("long")))
    one = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max(F.when(F.col("k") == 0, F.col("l"))).alias("n"),
                                             F.collect_list(F.when(F.col("k") > 0, F.struct("k", "l", "r"))).alias("cuts"))
    cost = F.expr("transform(cuts, x -> struct((cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(x.l as decimal(19, 0)) * cast(x.r as decimal(19, 0))) as score, x.k as k, x.l as l, x.r as r))")
    got = one.select("lang", "phrase", "a", "n", F.array_min(cost).alias("c")).select("lang", "phrase", "a", "n", "c.l", "c.r", "c.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most phrases: each share of it hands in its first `top` rows.
    share = Window.partitionBy("lang", "salt").orderBy(*best)
    got = got.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("at", F.row_number().over(share)).where(F.col("at") <= top).drop("salt", "at")
    got = got.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return got.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {"op12_collocations": """
WITH low AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split(translate(t, ',;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || chr(9), '......' || '...' || ' '), '.')) AS piece FROM low),
w AS (SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 100),
sub AS (SELECT lang, size, a AS longer, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM c, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3, 4]) AS m) WHERE m < size AND i + m - 1 <= size),
kept AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, phrase, max(longer) AS longer FROM sub GROUP BY ALL) s USING (lang, phrase) WHERE s.longer IS NULL OR 100 * s.longer < 100 * a),
cuts AS (SELECT kept.lang, kept.phrase, a, x.f AS l, y.f AS r, n.n, j, ((1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
 FROM kept, (SELECT unnest([1, 2, 3, 4]) AS j), n, f x, f y
 WHERE j < size AND n.lang = kept.lang AND x.lang = kept.lang AND x.phrase = array_to_string(ws[1:j], ' ') AND y.lang = kept.lang AND y.phrase = array_to_string(ws[j + 1:size], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""}
