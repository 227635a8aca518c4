"""Alignment of two tokenizers' tokens over the same bytes, as relations.

`align` is the operator: tokens exploded with their positions, windowed cumulative lengths as ends,
an equi-join of both sides on (key, end), running counts of the cuts found as group ids, and joins
on (key, group) for links. It knows nothing of tokenizers or texts.

Most of a corpus repeats itself, so `split_blocks` first splits texts where neither tokenizer ever
merges (checked on their vocabularies) and numbers each block's distinct chunks; `encode_parts`
brings all blocks' chunks together by parts of their hashes and encodes each text once; `align` takes
the corpus' distinct chunks as its keys, and `by_document` hands their results back to the blocks
and adds them up along each document.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, drop_cut, held, table
from .tokens import _BYTES

#: Text bytes of a block, bits of a key that number a block's documents, and how many parts chunks and pairs are dealt to.
BLOCK_BYTES, LOCAL_BITS, PARTS = 16 << 20, 25, 512
SPLIT = "block long, part int, c long, doc_ids array<long>, data binary, kind int"
TOKENS = "kind int, part int, c long, ok boolean, a array<struct<id:int,n:int>>, b array<struct<id:int,n:int>>, block long, data binary"
_MARK = "▁"


class Pair:
    """Both tokenizers, and where texts may be split.

    A splits at white space and between letters and marks before it merges. B merges neighbours
    only into pieces of its vocabulary, so it never merges over a pair of characters that no piece holds.
    """

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in _BYTES.items()}
        size = self.a.get_vocab_size()
        self.bytes_a = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in map(self.a.id_to_token, range(size))]
        model = pb.ModelProto()
        with open(path_b, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False  # texts come with their space
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.bytes_b = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(_MARK, " ").encode() for p in model.pieces]
        self.len_a, self.len_b = np.array(list(map(len, self.bytes_a)), "i4"), np.array(list(map(len, self.bytes_b)), "i4")
        pieces = [p.piece for p in model.pieces if p.type == p.NORMAL]
        cuts = []
        if not any(re.search(f"[^{_MARK}]{_MARK}|\n", p) for p in pieces):
            cuts.append(r"(?<=\S)(?=[ \n])")
        if not any(re.search(r"[A-Za-z][.,;:!?]", p) for p in pieces):
            cuts.append(r"(?<=[A-Za-z])(?=[.,;:!?])")
        self.split = re.compile("|".join(cuts)).split if cuts else lambda t: [t]

    def encode(self, chunks: list[str]):
        """ok, a, b: whether both sides' bytes are the chunk's, and ids."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.b.encode(chunks, num_threads=1)
        raw = [t.encode() for t in chunks]
        get_a, get_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        ok = [b"".join(map(get_a, x)) == r == b"".join(map(get_b, y)) for x, y, r in zip(a, b, raw)]
        return ok, a, b


class _Numbers(dict):
    def __missing__(self, w):
        self[w] = out = len(self)
        return out


def _lists(ids: list[list[int]], lens: np.ndarray) -> pa.Array:
    flat = np.fromiter((i for x in ids for i in x), "i4")
    ends = np.cumsum([0, *map(len, ids)]).astype("i4")
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat), pa.array(lens[flat])], ["id", "n"]))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, as narrow as they can be, compressed together."""
    out = []
    for x in arrays:
        x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
        out += [np.array([x.itemsize, len(x)], "<i8").tobytes(), x.tobytes()]
    return zstandard.compress(b"".join(out), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(data), 0, []
    while at < len(data):
        width, n = np.frombuffer(data, "<i8", 2, at).tolist()
        out.append(np.frombuffer(data, f"<u{width}", n, at + 16))
        at += 16 + width * n
    return out


def _rows(schema: str, n: int, **cols) -> pa.RecordBatch:
    """n rows of a schema's flat columns; a column that isn't given is null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    kinds |= {"array<long>": pa.list_(pa.int64()), "array<struct<id:int,n:int>>": pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int32())]))}
    names, arrays = [], []
    for name, kind in (x.split() for x in schema.split(", ")):
        x, kind = cols.get(name), kinds[kind]
        names.append(name)
        arrays.append(pa.nulls(n, kind) if x is None else x if isinstance(x, pa.Array) else pa.array(np.full(n, x) if isinstance(x, int) else x, kind))
    return pa.record_batch(arrays, names=names)


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + n[0] - 1, start[1], ...: where ragged rows lie."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _dealt(part: np.ndarray):
    """(part, ascending indexes) of each part that has any."""
    order = np.argsort(part, kind="stable")
    ends = np.flatnonzero(np.diff(part[order])) + 1
    for at in np.split(order, ends):
        if len(at):
            yield int(part[at[0]]), at


def split_blocks(docs: DataFrame, path_a: str, path_b: str, id_col="doc_id", text_col="text") -> DataFrame:
    """SPLIT, in rows of two kinds: 0, a block's distinct chunks of one part (packed: steps between their numbers there, lengths
    in bytes, bytes); 1, some of its documents: their ids, and packed, how many chunks each has and their numbers in order (none for
    null and empty texts), low bytes first. c counts a block's documents. Chunks are numbered from the most frequent on."""

    def run(batches):
        pair = held(("pair", path_a, path_b), lambda: Pair(path_a, path_b))
        block, chunks, size, ids, seqs = TaskContext.get().partitionId() << 20, _Numbers(), 0, [], []

        def flush():
            flat, lens = np.concatenate(seqs), np.fromiter(map(len, seqs), "i8", len(seqs))
            order, number = np.argsort(-np.bincount(flat, minlength=len(chunks)), kind="stable"), np.zeros(len(chunks), "u4")
            number[order] = np.arange(len(chunks))
            every, flat = [t.encode() for t in chunks], number[flat]
            every = [every[i] for i in order.tolist()]
            parts, data = [], []
            for k, at in _dealt(np.fromiter(map(zlib.crc32, every), "u4", len(every)) % PARTS):
                texts = [every[i] for i in at.tolist()]
                parts.append(k)
                data.append(_pack(np.diff(at, prepend=0), np.fromiter(map(len, texts), "i8", len(texts)), np.frombuffer(b"".join(texts), "u1")))
            yield _rows(SPLIT, len(parts), kind=0, block=block, part=parts, data=data)
            ends, lo = np.cumsum(lens), 0
            first, some, data = [], [], []
            while lo < len(ids):  # about 50,000 chunks together
                at = int(ends[lo] - lens[lo])
                hi = max(lo + 1, int(np.searchsorted(ends, at + 50_000)))
                first.append((block << LOCAL_BITS) + lo)
                some.append(ids[lo:hi])
                data.append(_pack(lens[lo:hi], *flat[at:ends[min(hi, len(ids)) - 1]].astype("<u4").view("u1").reshape(-1, 4).T))
                lo = hi
            yield _rows(SPLIT, len(first), kind=1, block=block, c=first, doc_ids=some, data=data)

        for x in batches:
            for i, t in zip(x.column("doc_id").to_pylist(), x.column("text").to_pylist()):
                ids.append(i)
                seqs.append(np.fromiter(map(chunks.__getitem__, pair.split(" " + t)), "u4") if t else np.zeros(0, "u4"))
                size += len(t or "")
                if size >= BLOCK_BYTES:
                    yield from flush()
                    block, chunks, size, ids, seqs = block + 1, _Numbers(), 0, [], []
        if ids:
            yield from flush()
        pa.default_memory_pool().release_unused()  # the worker goes on with other tasks

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SPLIT)


def _seqs(data: bytes) -> list[np.ndarray]:
    """Documents' chunk numbers, of a row of theirs."""
    lens, *planes = _unpack(data)
    flat = np.ascontiguousarray(np.stack(planes, 1)).view("<u4").ravel()
    return np.split(flat, np.cumsum(lens, dtype="i8")[:-1])


def encode_parts(pieces: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """TOKENS, in rows of two kinds: 0, a distinct chunk of the corpus with both sides' tokens, numbered in its part from 0 on
    (c is the part and that number); 1, of a block and a part: steps between the chunks' numbers in the block, and their numbers in the part."""

    def run(batches):
        pair = held(("pair", path_a, path_b), lambda: Pair(path_a, path_b))
        part, seen, todo, at = None, None, [], []

        def encoded():
            ok, a, b = pair.encode(todo)
            yield _rows(TOKENS, len(todo), kind=0, part=[c >> 32 for c in at], c=at, ok=ok, a=_lists(a, pair.len_a), b=_lists(b, pair.len_b))
            todo.clear()
            at.clear()

        for x in batches:
            packed = []
            for p, data in zip(x.column("part").to_pylist(), x.column("data").to_pylist()):
                if p != part:
                    part, seen = p, _Numbers()
                steps, lens, text = _unpack(data)
                text, ends, known = text.tobytes(), np.cumsum(lens, dtype="i8").tolist(), len(seen)
                texts = [text[lo:hi] for lo, hi in zip([0, *ends], ends)]
                of = list(map(seen.__getitem__, texts))
                packed.append(_pack(steps, np.array(of)))
                todo += [t.decode() for t, g in zip(texts, of) if g >= known]
                at += [part << 32 | g for g in of if g >= known]
                if len(todo) >= 20_000:
                    yield from encoded()
            yield _rows(TOKENS, len(packed), kind=1, part=x.column("part"), block=x.column("block"), data=packed)
        if todo:
            yield from encoded()
        pa.default_memory_pool().release_unused()

    return _streamed(pieces, "part", ("block",), run, TOKENS)


@contextlib.contextmanager
def _set(spark, value: str, *names: str):
    was = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in zip(names, was):
            spark.conf.set(name, value)


def one_deal(spark):
    """Joins on more columns than rows are dealt by leave them where they are: all of align's work is within a key.
    A side's tokens are read whole by both its uses, so that one exchange serves them."""
    return _set(spark, "false", "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.optimizer.expression.nestedPruning.enabled", "spark.sql.optimizer.nestedSchemaPruning.enabled")


def shuffles_end(spark):
    """Shuffle files go as soon as what reads them is written; else they stay until the driver happens to collect its garbage."""
    return _set(spark, "true", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")


def align(tokens: DataFrame, key: str = "c") -> DataFrame:
    """key, n_a, n_b, groups, n_groups, links, spans: tokens (arrays a and b of (id, n: bytes)) cut into groups where both sides' tokens end.

    Both sides must cover the same bytes and every token at least one. groups is text, `a1,a2|b1;...`; links holds the
    ids (a, b) of each pair of tokens that overlap, by A token, and spans how many each A token has. Keys must be distinct; rows without tokens are
    left out. Rows are dealt once a side, by key; run it within `one_deal`, or joins deal them again. The
    work of a group is the product of its sides' tokens.
    """
    tokens, before = tokens.repartition(key), Window.partitionBy(key).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)

    def side(col):
        one = tokens.select(key, F.posexplode(col).alias("pos", "t")).select(key, "pos", "t.id", "t.n")
        ends = one.withColumn("end", F.sum("n").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
        return ends.select(key, "id", (F.col("end") - F.col("n")).cast("int").alias("start"), F.col("end").cast("int").alias("end"))

    def grouped(one, other, name):
        got = one.join(other.select(key, "end", F.lit(1).alias("cut")), [key, "end"], "left").withColumn("g", F.coalesce(F.sum("cut").over(before), F.lit(0)))
        return got.groupBy(key, "g").agg(F.sort_array(F.collect_list(F.struct("start", "end", "id"))).alias(name))

    a, b = side("a"), side("b")
    both = grouped(a, b, "x").join(grouped(b, a, "y"), [key, "g"])
    ids = lambda c: F.array_join(F.transform(c, lambda t: t["id"].cast("string")), ",")
    links = F.transform("x", lambda t: F.transform(F.filter("y", lambda u: (u["start"] < t["end"]) & (t["start"] < u["end"])), lambda u: F.struct(t["id"].alias("a"), u["id"].alias("b"))))
    got = both.select(key, F.struct("g", F.concat_ws("|", ids("x"), ids("y")).alias("s"), links.alias("links"), F.size("x").alias("n_a"), F.size("y").alias("n_b")).alias("e"))
    got = got.groupBy(key).agg(F.sum("e.n_a").cast("int").alias("n_a"), F.sum("e.n_b").cast("int").alias("n_b"), F.sort_array(F.collect_list("e")).alias("e"))
    links = F.flatten("e.links")
    return got.select(key, "n_a", "n_b", F.array_join(F.col("e.s"), ";").alias("groups"), F.size("e").cast("long").alias("n_groups"), F.flatten(links).alias("links"), F.transform(links, F.size).alias("spans"))


#: What stands behind an id in groups' text, by its number.
MARKS = np.frombuffer(b",|;", "u1")
DOCS = "kind int, block long, part int, c long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, data binary"
#: What goes along with a part's chunks: their facts (kind 0), then the blocks that hold them (1).
FACTS = {"kind": "int", "part": "int", "c": "long", "n_a": "int", "n_b": "int", "groups": "string", "spans": "array<int>", "block": "long", "data": "binary"}
#: Packed rows of a block, of several kinds.
PACKED = "kind int, block long, part int, c long, doc_ids array<long>, data binary"


def _shaped(d: DataFrame, shape: dict, kind: int) -> DataFrame:
    return d.select(*[F.lit(kind).alias(k) if k == "kind" else F.col(k).cast(t).alias(k) if k in d.columns else F.lit(None).cast(t).alias(k) for k, t in shape.items()])


def _streamed(frame: DataFrame, key: str, order: tuple, run, schema: str) -> DataFrame:
    """run over a frame's rows, those of a key together and sorted."""
    return frame.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _pieces(batches, key="block"):
    """(key, kind, rows) of stretches of one key and kind."""
    for x in batches:
        block, kind = (x.column(n).to_numpy(zero_copy_only=False) for n in (key, "kind"))
        ends = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(block)]):
            if lo < hi:
                yield int(block[lo]), int(kind[lo]), x.slice(lo, hi - lo)


def _read(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of groups' text that ends in a mark, and the number of the mark behind each."""
    text = np.frombuffer(text, "u1")
    ends = np.flatnonzero((text < 48) | (text > 57))
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(ends)]
    ids, width = np.zeros(len(ends), "i8"), ends - starts
    for k in range(int(width.max(initial=0))):
        some = width > k
        ids[some] = 10 * ids[some] + text[starts[some] + k] - 48
    return ids, (text[ends] == MARKS[1]) + 2 * (text[ends] == MARKS[2])


def _written(ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The text that _read reads, and where each mark stands."""
    width = np.ones(len(ids), "i4")
    for k in range(1, len(str(int(ids.max(initial=0))))):
        width += ids >= 10**k
    ends = np.cumsum(width + 1, dtype="i8") - 1
    out = np.empty(int(ends[-1]) + 1 if len(ends) else 0, "u1")
    out[ends] = MARKS[marks]
    for k in range(int(width.max(initial=0))):
        some = width > k
        out[ends[some] - 1 - k] = ids[some] // 10**k % 10 + 48
    return out.tobytes(), ends


def _hand_out(batches):
    """PACKED, for each block and part: steps between numbers, then n_a, n_b, ids, the marks behind them and the spans of its chunks.

    No two tokens end together within a group, so each A token's links begin at the B token where those of the one before
    it end: spans and ids give the links.
    """
    part, got = None, None
    for p, kind, x in _pieces(batches, "part"):
        if p != part:
            part, got, facts = p, [], None
        if kind == 0:
            n = np.stack([x.column(k).cast("int64").fill_null(0).to_numpy(zero_copy_only=False) for k in ("n_a", "n_b")])
            ids, marks = _read(b"".join(g + b";" for g in x.column("groups").cast("binary").to_pylist() if g))
            got.append((n, np.stack([ids, marks]), x.column("spans").flatten().to_numpy(zero_copy_only=False).astype("i8")))
            continue
        if facts is None:
            n, tokens, spans = (np.concatenate(y, -1) for y in zip(*got))
            facts, got = (n, tokens, spans, np.cumsum(n.sum(0)) - n.sum(0), np.cumsum(n[0]) - n[0]), []
        n, tokens, spans, token_at, span_at = facts
        packed = []
        for data in x.column("data").to_pylist():
            steps, of = _unpack(data)
            some = n[:, of]
            packed.append(_pack(steps, *some, *tokens[:, _spans(token_at[of], some.sum(0))], spans[_spans(span_at[of], some[0])]))
        yield _rows(PACKED, len(packed), kind=0, block=x.column("block"), part=x.column("part"), data=packed)


class _Chunks:
    """A block's chunks as they come, part by part; `at` finds one by its number. Columns of numbers: n_a, n_b, n_groups, n_links."""

    def __init__(self, packed):
        at, got = [], []
        for steps, *rest in map(_unpack, packed):
            at.append(np.cumsum(steps, dtype="i8"))
            got.append(rest)
        n_a, n_b, ids, marks, spans = (np.concatenate(y).astype(kind) for y, kind in zip(zip(*got), ("i8", "i8", "i4", "u1", "i4")))
        at, got = np.concatenate(at), None
        self.at = np.zeros(len(at), "i8")
        self.at[at] = np.arange(len(at))
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])
        ends, ends_a, groups, linked = np.cumsum(n_a + n_b), np.cumsum(n_a), upto(marks == 2), upto(spans)
        self.start = linked[ends_a - n_a]
        self.numbers = np.stack([n_a, n_b, groups[ends] - groups[ends - n_a - n_b], linked[ends_a] - self.start], 1)
        text, cuts = _written(ids, marks)
        cuts = np.concatenate([[0], cuts + 1])[np.concatenate([[0], ends])].tolist()
        self.texts = [text[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
        is_b = upto(marks == 1)[:-1] > groups[:-1]
        start = (linked - np.arange(len(linked)))[:-1] + groups[:-1][~is_b]
        pairs = np.repeat(ids[~is_b].astype("i8"), spans) << 32 | ids[is_b][_spans(start, spans)]
        del at, n_a, n_b, ids, marks, spans, ends, ends_a, groups, linked, text, cuts, is_b, start
        self.pairs, link = np.unique(pairs, return_inverse=True)
        self.link = link.astype("i4")

    def links(self, chunks: np.ndarray) -> np.ndarray:
        """Indexes into pairs of the links of some chunks."""
        return self.link[_spans(self.start[chunks], self.numbers[chunks, 3])]


def _first_pass(batches):
    """Rows of DOCS: documents (kind 0), and of a block: pairs of ids of one part with how many of its documents hold them linked
    (kind 1: steps between their numbers, a, b, counts), its chunks' links in order of number (kind 2: how many, numbers of pairs)."""
    block, packed, chunks, held_by = None, [], None, None
    held(("pair", None), lambda: None)  # no tokenizers from here on

    def rest():
        if chunks is not None:
            some = np.flatnonzero(held_by)
            a, b, n = chunks.pairs[some] >> 32, chunks.pairs[some] & 0xFFFFFFFF, held_by[some]
            parts = [(k, _pack(np.diff(some[at], prepend=0), a[at], b[at], n[at])) for k, at in _dealt(a % PARTS)]
            yield _rows(DOCS, len(parts), kind=1, block=block, part=[k for k, _ in parts], data=[x for _, x in parts])
            for c, lo in enumerate(range(0, len(chunks.at), 50_000)):
                at = chunks.at[lo:lo + 50_000]
                yield _rows(DOCS, 1, kind=2, block=block, c=[c], data=[_pack(chunks.numbers[at, 3], chunks.links(at))])

    for b, kind, x in _pieces(batches):
        if b != block:
            yield from rest()
            block, packed, chunks = b, [], None
        if kind == 0:
            packed += x.column("data").to_pylist()
            continue
        if packed:
            chunks, packed = _Chunks(packed), []
            held_by = np.zeros(len(chunks.pairs), "i8")
        for c, ids, data in zip(*(x.column(n).to_pylist() for n in ("c", "doc_ids", "data"))):
            sums, digests = np.zeros((len(ids), 4), "i8"), [""] * len(ids)
            for i, seq in enumerate(_seqs(data)):
                if len(seq):
                    seq = chunks.at[seq]
                    mine = chunks.numbers[seq]
                    if mine[:, 0].all():  # a chunk without tokens is one that a side can't give back
                        sums[i] = mine.sum(0)
                        held_by[np.unique(chunks.links(np.unique(seq)))] += 1
                        digests[i] = hashlib.sha256(b"".join(map(chunks.texts.__getitem__, seq.tolist()))[:-1]).hexdigest()
            yield _rows(DOCS, len(ids), kind=0, block=block, c=c + np.arange(len(ids)), doc_id=ids, groups_sha256=digests, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums.T)))
    yield from rest()


def _totals(batches):
    """PACKED, for each row of pairs: the numbers' steps, the corpus' count of each, and whether it is its A id's highest. A part holds all pairs of its A ids."""
    part, got, sums = None, [], None

    def add(pairs, counts):
        pairs, of = np.unique(np.concatenate(pairs), return_inverse=True)
        return [pairs], [np.bincount(of, np.concatenate(counts), len(pairs)).astype("i8")]

    def out():
        if got:
            (pairs,), (counts,) = add(*sums)
            heads = np.flatnonzero(np.diff(pairs >> 32, prepend=-1))
            best = counts == np.repeat(np.maximum.reduceat(counts, heads), np.diff(heads, append=len(pairs)))
            for lo in range(0, len(got), 100):
                blocks, data = zip(*got[lo:lo + 100])
                packed = []
                for steps, a, b, _ in map(_unpack, data):
                    at = np.searchsorted(pairs, a.astype("i8") << 32 | b.astype("i8"))
                    packed.append(_pack(steps, counts[at], best[at].astype("u1")))
                yield _rows(PACKED, len(packed), kind=1, block=list(blocks), part=part, data=packed)

    for x in batches:
        for p, block, data in zip(*(x.column(n).to_pylist() for n in ("part", "block", "data"))):
            if p != part:
                yield from out()
                part, got, sums = p, [], ([], [])
            got.append((block, data))
            _, a, b, n = _unpack(data)
            sums[0].append(a.astype("i8") << 32 | b.astype("i8"))
            sums[1].append(n.astype("i8"))
            if len(sums[0]) > 64:
                sums = add(*sums)
    yield from out()


def _second_pass(batches):
    """c, n_best, count_sum of documents, given their block's links and the totals of its pairs."""
    block = None
    for b, kind, x in _pieces(batches):
        if b != block:
            block, links, totals, value = b, [], [], None
        if kind < 2:
            (totals if kind else links).extend(map(_unpack, x.column("data").to_pylist()))
            continue
        if value is None and links:
            n, of = (np.concatenate(y).astype("i8") for y in zip(*links))
            of_pair = np.zeros((int(of.max(initial=-1)) + 1, 2), "i8")  # pairs of documents without tokens alone have no total
            for steps, count, best in totals:
                of_pair[np.cumsum(steps, dtype="i8")] = np.stack([best, count], 1)
            run = np.vstack([np.zeros((1, 2), "i8"), np.cumsum(of_pair[of], 0)])
            ends = np.cumsum(n)
            value, links, totals = run[ends] - run[ends - n], [], []
        for c, data in zip(*(x.column(n).to_pylist() for n in ("c", "data"))):
            seqs = _seqs(data)
            sums = np.array([value[seq].sum(0) if len(seq) and n[seq].all() else (0, 0) for seq in seqs], "i8")
            yield pa.record_batch([pa.array(c + np.arange(len(seqs))), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["c", "n_best", "count_sum"])


def by_document(docs: DataFrame, path_a: str, path_b: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each row of docs.

    A pair of ids counts as many documents as hold it linked; n_best is how many of a document's
    links have their A id's highest count (ties included), count_sum the sum over its links. Null
    and empty texts, and those whose tokens' bytes differ from the text's on either side, have no
    tokens. Rows that repeat an id are documents of their own, ids may be null. A text of any length
    is split into chunks; what one task holds is a block's or a part's distinct chunks. Other columns are not
    read. An empty table gives no rows.
    """
    with shuffles_end(docs.sparkSession), one_deal(docs.sparkSession):
        split = cut(split_blocks(docs, path_a, path_b, id_col, text_col), "split", "kind")
        tokens = cut(encode_parts(split.where("kind = 0").select("part", "block", "data"), path_a, path_b), "tokens")
        drop_cut(split, "kind=0")
        chunks, packed = tokens.where("kind = 0"), dict(x.split() for x in PACKED.split(", "))
        papers = _shaped(split.where("kind = 1"), packed, 2)
        part = F.shiftright("c", 32).alias("part")
        # Chunks that a side can't give back have no tokens here, but keep their number.
        some = [F.when(F.col("ok"), F.col(x)).otherwise(F.array().cast(tokens.schema[x].dataType)).alias(x) for x in ("a", "b")]
        facts = _shaped(align(chunks.select("c", *some)).select("*", part), FACTS, 0)
        facts = facts.unionByName(_shaped(chunks.where("not ok").select("c", part), FACTS, 0))  # as a rule none
        facts = facts.unionByName(_shaped(tokens.where("kind = 1").select("part", "block", "data"), FACTS, 1))
        facts = _streamed(facts, "part", ("kind", "c", "block"), _hand_out, PACKED)
        got = cut(_streamed(facts.unionByName(papers), "block", ("kind", "part", "c"), _first_pass, DOCS), "counted")
    drop_cut(tokens)
    totals = _streamed(got.where("kind = 1").select("part", "block", "data"), "part", ("block",), _totals, PACKED)
    rest = _shaped(got.where("kind = 2").select("block", "c", "data"), packed, 0).unionByName(totals).unionByName(papers)
    sums = _streamed(rest, "block", ("kind", "c"), _second_pass, "c long, n_best long, count_sum long")
    return got.where("kind = 0").join(sums, "c").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark, sf_dir, path_a: str | None = None, path_b: str | None = None):
    import public_tokenizers as P

    return by_document(table(spark, sf_dir, "documents"), path_a or P.path("byte_bpe_50k.json"), path_b or P.path("piece_bpe_32k.model"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLES: dict = {}
