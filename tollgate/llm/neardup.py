"""Near-duplicate groups: MinHash coordinates in an inverted join, links confirmed on full sets.

Every text's set of word shingles gives `K` minima. Texts of equal sets are one class from
then on, so copies cost nothing further. A class posts itself under coordinate-value
pairs; pairs are ordered by how many classes hold them, and a class posts only the first
K - MATCH + 1 of its own in that order (two classes that agree in MATCH coordinates share
one of those), which skips common pairs wherever rarer ones decide. Then

1. stars: each class meets a centre of the postings it shares most of; what is alike on full
   sets becomes one component. STARS rounds with other centres each, so a group of many near
   copies collapses at the cost of one pair a class and round;
2. merge: postings whose classes are all of one component are skipped, and so is every pair
   within one. Of the rest, collisions are counted, and the classes that have MATCH of K in
   common with another component are listed (classes, never pairs);
3. proof: listed classes of components that touch meet once more, with their full sets, in
   tasks that count intersections exactly and give at most one link for two components.

A group (posting, or components that touch) is dealt into blocks. Its largest component needs
no comparison with itself, so its rows go to one block each; only the rest is copied to all
blocks. Work and rows are in proportion to a group's size times its outliers in blocks, not
to its square. At similarity 0.8 a pair has fewer than MATCH of K collisions with a chance of
1.3e-6, if the hash functions are taken as independent.

Every join is a sort merge. Left to itself, Spark broadcasts a side by the size it takes it
for, an array counting as one element: signatures would pass for a fraction of their size and
go through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import components, cut, drop_cut, held, table

K, MATCH, STARS = 32, 14, 1
#: Rows of a posting, and shingles of touching components, that a block holds about.
BLOCK, BLOCK_SHINGLES = 2000, 1 << 20
#: Bytes of words that a worker's memo holds about.
MEMO_BYTES = 32 << 20
_MULT = np.random.default_rng(20).integers(1, 2**63, K, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_C = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words; emptied when its words (and some 150 bytes each) pass MEMO_BYTES."""

    size = 0

    def __missing__(self, w):
        out = xxhash.xxh3_64_intdigest(w)
        if len(w) <= 64:
            self.size += len(w) + 150
            if self.size > MEMO_BYTES:
                self.clear()
                self.size = 0
            self[w] = out
        return out


def shingles(text: str | None, n: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; ASCII letters are lowered, ASCII
    white space parts words. Fewer words than n give one shingle, none give none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    if len(h) == 0:
        return h
    m = max(len(h) - n + 1, 1)
    out = np.full(m, min(len(h), n), np.uint64)
    for i in range(min(n, len(h))):
        out = (out ^ (out >> np.uint64(29))) * _C + h[i:i + m]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(31)))


def signature(s: np.ndarray) -> np.ndarray:
    """K minima of 32 bits, as signed integers."""
    out = np.empty(K, np.uint32)
    for lo in range(0, K, 4):  # a few at a time, so a very long text needs a few times its own size
        out[lo:lo + 4] = ((s[None, :] * _MULT[lo:lo + 4, None]) >> np.uint64(32)).min(axis=1)
    return out.view(np.int32)


def similar(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _signatures(n: int):
    def run(frames):
        words = held("words", _Words)
        for f in frames:
            rows = []
            for k, t in zip(f["key"], f["text"]):
                s = shingles(t, n, words)
                rows.append((k, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, signature(s) if len(s) else None))
            yield pd.DataFrame(rows, columns=["key", "n", "digest", "sig"]).astype({"key": "Int64"})
    return run


#: Bits of the filter below: 1 MB, whatever the input. A full filter only passes more rows.
BITS = 1 << 23


def _sets(base: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """digest, shingles of the rows whose key is wanted (and of few others): a second pass over the texts.

    A bitmap of the keys' hashes, of a fixed size, keeps the rest out before anything is shuffled.
    """
    h = F.pmod(F.xxhash64("key"), F.lit(BITS)) + 1
    got = wanted.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    size = 8 * 4096
    mask = np.zeros(BITS + size, np.uint8)
    for r in got.collect():  # BITS bits at most
        # Buckets are numbered from 1 and hold the positions after (at - 1) * size, the last being at * size.
        lo = (int(r["at"]) - 1) * size
        mask[lo:lo + size] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    packed = base.sparkSession.sparkContext.broadcast(np.packbits(mask))

    def run(frames):
        bits, words = np.unpackbits(packed.value), held("words", _Words)
        for f in frames:
            f = f[bits[f["at"].to_numpy()] == 1]
            for lo in range(0, len(f), 256):
                got = [shingles(t, n, words).tobytes() for t in f["text"].iloc[lo:lo + 256]]
                yield pd.DataFrame({"digest": [xxhash.xxh3_128_digest(s) for s in got], "shingles": got})

    place = (F.bitmap_bucket_number(h) - 1) * size + F.bitmap_bit_position(h)
    return base.where("key is not null").select("text", place.alias("at")).mapInPandas(run, "digest binary, shingles binary")


@F.pandas_udf(T.BooleanType())
def _confirm(a: pd.Series, b: pd.Series, percent: pd.Series) -> pd.Series:
    return pd.Series([similar(x, y, p) for x, y, p in zip(a, b, percent)])


def _star(posting: DataFrame, comp: DataFrame | None, classes: DataFrame, base: DataFrame, turn: int, n: int, percent: int, k: int) -> DataFrame:
    """Links (a, b) of classes with the centre that they share most postings with."""
    p = posting
    if comp is not None:
        p = posting.join(comp.select(F.col("node").alias("cid"), "component").hint("merge"), "cid", "left").select("cid", "x", F.coalesce("component", "cid").alias("comp"))
    else:
        p = posting.withColumn("comp", F.col("cid"))
    centre = p.groupBy("x").agg(F.min(F.struct(F.xxhash64("cid", F.lit(turn)).alias("h"), "cid", "comp")).alias("s"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    pairs = p.join(centre.select("x", F.col("s.cid").alias("a"), F.col("s.comp").alias("ca")).hint("merge"), "x").where("comp != ca")
    best = pairs.groupBy("cid", "a").agg(F.count("*").alias("c")).groupBy("cid").agg(F.max(F.struct("c", "a")).alias("m")).select(F.col("m.a").alias("a"), F.col("cid").alias("b"))
    # Only pairs that are likely alike: whoever is not tried here is compared in the merge.
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("sig").alias(f"s{c}"), F.col("digest").alias(f"d{c}"), F.col("rep").alias(f"r{c}"), F.col("n").alias(f"n{c}")).hint("merge")
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda v, x: v + x)
    likely = best.join(side("b"), "b").join(side("a"), "a").where((same >= int(0.7 * k)) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    likely = cut(likely.select("a", "b", "da", "db", "ra", "rb"), "likely")
    sets = cut(_sets(base, likely.select(F.explode(F.array("ra", "rb")).alias("key")), n).dropDuplicates(["digest"]), "sets")
    got = likely.join(sets.select(F.col("digest").alias("db"), F.col("shingles").alias("tb")).hint("merge"), "db").join(sets.select(F.col("digest").alias("da"), F.col("shingles").alias("ta")).hint("merge"), "da")
    got = cut(got.where(_confirm("ta", "tb", F.lit(percent))).select("a", "b"), "links")
    drop_cut(likely)
    drop_cut(sets)
    return got


def _deal(rows: DataFrame, by: list[str], weight, limit: int) -> DataFrame:
    """Rows (cid, comp, ...) of the groups that hold several components, dealt to tasks (t1, t2).

    Two rows of different components meet in one task at least. Blocks hold about `limit` of
    weight; rows of the group's heaviest component go to one block of their own kind, times the
    blocks of the rest.
    """
    per = rows.groupBy(*by, "comp").agg(F.sum(weight).alias("w"))
    main = per.groupBy(*by).agg(F.count("*").alias("many"), F.max(F.struct("w", "comp")).alias("top"), F.sum("w").alias("all")).where("many > 1")
    blocks = lambda w: F.ceil(w / limit).cast("int")
    main = main.select(*by, F.col("top.comp").alias("main"), blocks(F.col("top.w")).alias("bd"), blocks(F.col("all") - F.col("top.w")).alias("br"))
    d = rows.join(main.hint("merge"), by).withColumn("is_main", F.col("comp") == F.col("main"))
    d = d.withColumn("own", F.pmod(F.xxhash64("cid"), F.when(F.col("is_main"), F.col("bd")).otherwise(F.col("br"))).cast("int"))
    task = lambda a, b: F.struct(a.cast("int").alias("t1"), b.cast("int").alias("t2"))
    rest, own = F.sequence(F.lit(0), F.col("br") - 1), F.col("own")
    of_main = F.transform(rest, lambda r: task(own, r))
    of_rest = F.concat(F.transform(F.sequence(F.lit(0), F.col("bd") - 1), lambda m: task(m, own)),
                       F.transform(F.filter(rest, lambda r: r != own), lambda r: task(-1 - F.least(own, r), F.greatest(own, r))))
    d = d.withColumn("task", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_rest)))
    return d.select(*rows.columns, "task.t1", "task.t2")


class _Join:
    """Union-find over component ids."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _by_task(names: list[str], work, columns: list[str]):
    """mapInPandas body: work on the rows of each task in turn. Rows come sorted by names; a
    task's rows that a batch cuts off wait for the next batch."""
    def run(frames):
        kept = None
        for f in frames:
            if kept is not None:
                f = pd.concat([kept, f], ignore_index=True)
            ids = f[names].to_numpy()
            edge = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            out = []
            for lo, hi in zip([0, *edge.tolist()], edge.tolist()):
                out += work(f.iloc[lo:hi])
            kept = f.iloc[edge[-1]:] if len(edge) else f
            yield pd.DataFrame(out, columns=columns, dtype="int64")
        if kept is not None and len(kept):
            yield pd.DataFrame(work(kept), columns=columns, dtype="int64")
    return run


def _touching(match: int, percent: int):
    """Of one posting's task: (cid, comp, root) of the classes with `match` collisions across components;
    root stands for the components that meet there."""
    def work(f):
        comp, cid, n = f["comp"].to_numpy(), f["cid"].to_numpy(), f["n"].to_numpy()
        values, counts = np.unique(comp, return_counts=True)
        if len(values) < 2:
            return []
        sig = np.stack(f["sig"].to_numpy())
        seen, join = np.zeros(len(comp), bool), _Join()
        for i in np.flatnonzero(comp != values[counts.argmax()]):
            ok = (sig == sig[i]).sum(axis=1) >= match
            ok &= (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if ok.any():
                seen |= ok
                seen[i] = True
                for c in np.unique(comp[ok]).tolist():
                    join.join(int(comp[i]), c)
        return [(int(cid[i]), int(comp[i]), join.find(int(comp[i]))) for i in np.flatnonzero(seen)]
    return work


def _proof(percent: int):
    """Of one task's classes with full sets: (a, b) of each component that is linked there and the least one it reaches."""
    def work(f):
        comp = f["comp"].to_numpy()
        values, counts = np.unique(comp, return_counts=True)
        if len(values) < 2:
            return []
        sets = [np.frombuffer(s, np.uint64) for s in f["shingles"]]
        size, join = np.array([len(s) for s in sets]), _Join()
        if len(sets) == 2:
            return [(int(comp.min()), int(comp.max()))] if similar(*f["shingles"], percent) else []
        value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        for i in np.flatnonzero(comp != values[counts.argmax()]):
            lo, hi = np.searchsorted(value, sets[i], "left"), np.searchsorted(value, sets[i], "right")
            held = hi - lo
            at = np.arange(held.sum()) + np.repeat(lo - np.r_[0, held.cumsum()[:-1]], held)
            both = np.bincount(owner[at], minlength=len(sets))
            ok = (100 * both >= percent * (size[i] + size - both)) & (comp != comp[i])
            for c in np.unique(comp[ok]).tolist():
                join.join(int(comp[i]), c)
        return [(join.find(c), c) for c in join.up]
    return work


def groups(docs: DataFrame, id_col="doc_id", text_col="text", n: int = 5, percent: int = 80, match: int = MATCH) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Rows link if 100 * intersection >= percent * union of their sets of word n-grams. Null,
    empty and blank texts have the empty set and link with nothing. Rows that repeat an id
    give a row each, with sizes of their own, and share the id's component. A row with a
    null id is kept, with itself (null) as component. Other columns are not read. match = 1
    posts every coordinate and compares all that share one, for the highest recall.
    """
    base = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    all_sets = cut(base.mapInPandas(_signatures(n), "key long, n long, digest binary, sig array<int>"), "signatures")
    use = all_sets.where("digest is not null and key is not null")
    classes = use.groupBy("digest").agg(F.min("key").alias("rep"), F.first("n").cast("int").alias("n"), F.first("sig").alias("sig"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # Postings, rarest first. A class's own unshared pairs come before them, so it keeps K - match + 1 less those.
    pair = F.transform("sig", lambda v, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    posts = classes.select("cid", F.explode(pair).alias("x"))
    often = posts.groupBy("x").agg(F.count("*").alias("f")).where("f > 1")
    order = F.array_sort(F.collect_list(F.struct("f", "x")))
    per = posts.join(often.hint("merge"), "x").groupBy("cid").agg(order.alias("p")).withColumn("room", F.size("p") - match + 1).where("room > 0")
    posting = cut(per.select("cid", F.explode(F.slice("p", 1, F.col("room"))).alias("p")).select("cid", "p.x"), "posts")
    # An id with several sets ties their classes.
    several = use.groupBy("key").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo != hi").select("key")
    tied = use.join(several.hint("merge"), "key").join(classes.select("digest", "cid").hint("merge"), "digest").select("key", "cid").distinct()
    links = cut(tied.join(tied.groupBy("key").agg(F.min("cid").alias("a")).hint("merge"), "key").where("cid != a").select("a", F.col("cid").alias("b")), "links")
    # 1. Stars.
    comp = None if links.isEmpty() else cut(components(links), "components")
    for turn in range(STARS):
        found = _star(posting, comp, classes, base, turn, n, percent, K)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        comp = cut(components(links), "components")
    # 2. Merge.
    of = classes.select("cid", F.col("cid").alias("comp")) if comp is None else classes.select("cid").join(comp.withColumnRenamed("node", "cid").hint("merge"), "cid", "left").select("cid", F.coalesce("component", "cid").alias("comp"))
    of = cut(of, "components")
    todo = _deal(posting.join(of.hint("merge"), "cid"), ["x"], F.lit(1), BLOCK).join(classes.select("cid", "n", "sig").hint("merge"), "cid")
    by = ["x", "t1", "t2"]
    todo = todo.select(*by, "cid", "comp", "n", "sig").repartition(*by).sortWithinPartitions(*by)
    touch = cut(todo.mapInPandas(_by_task(by, _touching(match, percent), ["cid", "comp", "root"]), "cid long, comp long, root long").distinct(), "touching")
    # 3. Proof.
    drop_cut(posting)
    parts = components(touch.select(F.col("comp").alias("a"), F.col("root").alias("b")))
    listed = touch.select("cid", "comp").distinct().join(parts.select(F.col("node").alias("comp"), F.col("component").alias("part")).hint("merge"), "comp").join(classes.select("cid", "digest", "rep", "n").hint("merge"), "cid")
    listed = cut(listed, "listed")
    dealt = _deal(listed.select("part", "comp", "cid", "digest", "n"), ["part"], F.col("n"), BLOCK_SHINGLES)
    sets = _sets(base, listed.select(F.col("rep").alias("key")), n).dropDuplicates(["digest"])
    by = ["part", "t1", "t2"]
    near = dealt.join(sets.hint("merge"), "digest").select(*by, "comp", "shingles").repartition(*by).sortWithinPartitions(*by)
    more = cut(near.mapInPandas(_by_task(by, _proof(percent), ["a", "b"]), "a long, b long").distinct(), "links")
    wider = components(more).select(F.col("node").alias("comp"), F.col("component").alias("wide"))
    final = classes.select("cid", "digest", "rep").join(of.hint("merge"), "cid").join(wider.hint("merge"), "comp", "left").withColumn("comp", F.coalesce("wide", "comp"))
    low = final.groupBy("comp").agg(F.min("rep").alias("component_id"))
    final = cut(final.join(low.hint("merge"), "comp").select("digest", "component_id"), "components")
    for done in (touch, listed, classes, of):
        drop_cut(done)
    key = F.col("key")
    got = all_sets.select("key", "n", F.when(key.isNotNull(), F.col("digest")).alias("digest")).join(final.hint("merge"), "digest", "left")
    at = F.coalesce("component_id", key)
    return got.select(key.alias("doc_id"), F.col("n").alias("n_shingles"), at.alias("component_id"), F.coalesce(at == key, F.lit(True)).alias("kept"))


def op6_near_duplicates(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents"), n=2, percent=80)


QUERIES = {"op6_near_duplicates": op6_near_duplicates}
ORACLES: dict = {}
