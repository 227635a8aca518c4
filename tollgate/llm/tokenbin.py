"""Token-id files: per-document zstandard frames under one shared, trained dictionary.

A file set is a folder of two Parquet tables, so it lies in any store that Spark reaches
and its commit protocol covers lost executors:

dictionary   one row: dict_hash (sha256 of the dictionary), dictionary (binary)
blocks       rows of about `block_bytes`: shard, block, first_id, last_id, dict_hash, data
             (frames one after another), and the offset index: ids, offsets, lengths,
             n_tokens, starts (ids of the block before each document) as arrays

A short document is read by slicing data at its offset and expanding that frame alone.
Rows lie in ascending id order: shards by ranges of ids, blocks within shards.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .common import shared_dir, table
from .tokens import batches, encoder

#: Documents that the dictionary is trained on at most, ids of one that count, and its size.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 1000, 4096, 64 << 10
LEVEL, BLOCK_BYTES = 3, 1 << 18
#: Text characters that a shard holds about, and ranges of ids that are weighed for each shard.
SHARD_CHARS, RANGES = 64 << 20, 16
#: Ranges weighed at most while two a shard are fewer.
MOST_RANGES = 1 << 16
#: Parquet row groups, which writers and readers hold whole. Sizes are looked at after every row, not every
#: hundred, as a row is a block; frames are compressed already.
PARQUET = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 8,
           "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8, "compression": "none"}
BLOCKS = "shard int, block int, first_id long, last_id long, dict_hash string, data binary, ids array<long>, offsets array<long>, lengths array<long>, n_tokens array<long>, starts array<long>"


def with_ids(docs: DataFrame, tokenizer: str, end_id: int | None, id_col="doc_id", text_col="text", finish=None, schema="doc_id long, ids binary") -> DataFrame:
    """Every whole text's ids with end_id appended; finish turns (id, bytes) into rows of schema."""
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    finish = finish or (lambda i, ids: [(i, ids)])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        enc = encoder(tokenizer)
        for f in frames:
            texts, keys = f["text"].fillna("").tolist(), [None if no else k for k, no in zip(f["key"].tolist(), f["none"])]
            for lo, hi in batches(texts):
                rows = [r for k, x in zip(keys[lo:hi], enc.ids(texts[lo:hi])) for r in finish(k, x + tail)]
                out = pd.DataFrame(rows, columns=names)
                if "doc_id" in out:
                    out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    key = F.col(id_col).cast("long")
    return docs.select(F.coalesce(key, F.lit(0)).alias("key"), key.isNull().alias("none"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id, id_col="doc_id", text_col="text") -> bytes:
    """A dictionary from the serialized ids of at most SAMPLE_DOCS documents, those of smallest id hash.

    Empty if there is too little to train on; frames are then plain.
    """
    some = docs.select(F.col(id_col).alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some.distinct()), "doc_id").limit(SAMPLE_DOCS)
    first = lambda i, ids: [(i, ids[:4 * SAMPLE_IDS])]
    parts = sorted(bytes(r["ids"]) for r in with_ids(some, tokenizer, end_id, finish=first).toLocalIterator())
    try:
        return zstandard.train_dictionary(DICT_BYTES, [p for p in parts if len(p) >= 8]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _bounds(sizes: DataFrame) -> list[int]:
    """First ids of all shards but the first, from the sizes of RANGES ranges of ids a shard."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shards = -(-total // SHARD_CHARS)
    if shards < 2:
        return []
    parts = min(shards * RANGES, max(2 * shards, MOST_RANGES))
    marks = sorted({int(x) for x in sizes.approxQuantile("i", [j / parts for j in range(1, parts)], 0.2 / parts)})
    weight = {r["r"]: r["n"] for r in sizes.mapInArrow(_weigh(np.array(marks, "i8")), "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()}  # a row a range
    out, size = [], 0
    for r in range(len(marks) + 1):
        if size and size + weight.get(r, 0) > SHARD_CHARS:
            out.append(marks[r - 1])
            size = 0
        size += weight.get(r, 0)
    return out


def _weigh(marks):
    """Characters by range of ids: a search of the sorted bounds a batch, whatever their number. Null ids lie below all."""

    def run(batches):
        for b in batches:
            i, n = b.column("i"), b.column("n").fill_null(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(marks, i.fill_null(0).to_numpy(zero_copy_only=False), "right")
            at[i.is_null().to_numpy(zero_copy_only=False)] = 0
            some, inverse = np.unique(at, return_inverse=True)
            yield pa.record_batch([pa.array(some.astype("i8")), pa.array(np.bincount(inverse, n, len(some)).astype("i8"))], names=["r", "n"])

    return run


def _dict(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col="doc_id", text_col="text") -> None:
    """Encode every row and write the file set to path.

    Null texts count as empty. Null ids sort first; rows of one id lie by their frames'
    bytes. Shards are ranges of ids with about SHARD_CHARS of text each (one id is never
    parted); their bounds decide only where shards end, not what they hold. Other columns
    are not read. An empty table gives a file set without blocks.
    """
    spark = docs.sparkSession
    data = train_dictionary(docs, tokenizer, end_id, id_col, text_col)
    digest = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(digest, bytearray(data))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    bounds = _bounds(docs.select(F.col(id_col).cast("long").alias("i"), F.length(text_col).alias("n")))
    frames = with_ids(docs, tokenizer, end_id, id_col, text_col, finish=_Frames(data, bounds), schema="shard int, doc_id long, n long, frame binary")

    def pack(parts):
        block, size, rows, last = 0, 0, [], None

        def flush():
            before = lambda sizes: np.cumsum([0, *sizes])[:-1].tolist()
            ids, sizes, counts = [r[0] for r in rows], [len(r[2]) for r in rows], [r[1] for r in rows]
            some = [i for i in ids if i is not None]
            out = pd.DataFrame([(last, block, min(some, default=None), max(some, default=None), digest, b"".join(r[2] for r in rows), ids, before(sizes), sizes, counts, before(counts))],
                               columns=[x.split()[0] for x in BLOCKS.split(", ")])
            return out.astype({"first_id": "Int64", "last_id": "Int64"})

        for f in parts:
            for s, i, n, x in zip(f["shard"], f["doc_id"], f["n"], f["frame"]):
                if rows and (s != last or size + len(x) > BLOCK_BYTES):
                    yield flush()
                    block, size, rows = (block + 1 if s == last else 0), 0, []
                last = s
                rows.append((None if pd.isna(i) else int(i), int(n), x))
                size += len(x)
        if rows:
            yield flush()

    laid = frames.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "frame")
    laid.mapInPandas(pack, BLOCKS).write.options(**PARQUET).parquet(f"{path}/blocks")


class _Frames:
    """Compresses (id, ids) to (shard, id, n, frame); makes its compressor on the executor."""

    def __init__(self, data, bounds):
        self.data, self.bounds, self.c = data, bounds, None

    def __call__(self, i, ids):
        if self.c is None:
            self.c = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(self.data)) if self.data else zstandard.ZstdCompressor(level=LEVEL)
        at = 0 if i is None else bisect_right(self.bounds, i)
        return [(at, i, len(ids) // 4, self.c.compress(ids))]


def read(spark, path: str, finish=None, schema="shard int, block int, start long, doc_id long, n_tokens long, ids binary") -> DataFrame:
    """Every document of a file set, with its shard, its block there and its start (ids of the block before it);
    finish may turn (ids bytes) into the last column's value.

    Raises if a block was written under another dictionary.
    """
    row = spark.read.parquet(f"{path}/dictionary").first()
    data, digest = bytes(row["dictionary"]), row["dict_hash"]
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError("the dictionary does not match its hash")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        d = zstandard.ZstdDecompressor(dict_data=_dict(data)) if data else zstandard.ZstdDecompressor()
        for f in frames:
            if (f["dict_hash"] != digest).any():
                raise ValueError(f"a block needs dictionary {f['dict_hash'][f['dict_hash'] != digest].iloc[0]}")
            got = map(d.decompress, f["frame"])
            out = pd.DataFrame(zip(f["shard"], f["block"], f["start"], f["i"], f["n"], got if finish is None else map(finish, got)), columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64").mask(f["none"])  # nulls apart: a column with them would come as floats
            yield out

    # Frames are cut out before they leave the JVM, so a batch for Python holds frames, never many whole blocks.
    frames = _blocks(spark, path).select("shard", "block", "dict_hash", "data", F.explode(F.arrays_zip("ids", "offsets", "lengths", "n_tokens", "starts")).alias("x")).select(
        "shard", "block", "dict_hash", F.col("x.starts").alias("start"), F.coalesce("x.ids", F.lit(0)).alias("i"), F.col("x.ids").isNull().alias("none"), F.col("x.n_tokens").alias("n"), _frame())
    return frames.mapInPandas(run, schema)


def _blocks(spark, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def _frame():
    return F.expr("substring(data, cast(x.offsets + 1 as int), cast(x.lengths as int))").alias("frame")


def lookup(spark, path: str, doc_id: int) -> list[bytes]:
    """One id's documents. Only row groups whose range of ids holds it are read, and of their data only its frames."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["dictionary"])
    got = _blocks(spark, path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("shard", "block", "data", F.posexplode(F.arrays_zip("ids", "offsets", "lengths")).alias("at", "x"))
    got = got.where(F.col("x.ids") == doc_id).select("shard", "block", "at", _frame()).orderBy("shard", "block", "at").collect()
    d = zstandard.ZstdDecompressor(dict_data=_dict(data)) if data else zstandard.ZstdDecompressor()
    return [d.decompress(bytes(r["frame"])) for r in got]


def block_starts(spark, path: str) -> DataFrame:
    """shard, block, base: the ids of all blocks before each. Sums within shards first, then over one row per shard."""
    size = _blocks(spark, path).select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = size.withColumn("within", before(Window.partitionBy("shard").orderBy("block")))
    shards = size.groupBy("shard").agg(F.sum("size").alias("size")).select("shard", before(Window.orderBy("shard")).alias("shard_base"))
    return within.join(shards, "shard").select("shard", "block", (F.col("within") + F.col("shard_base")).alias("base"))


def op7_token_ids(spark, sf_dir, tokenizer: str | None = None, end_id: int = 2):
    """doc_id, start, n_tokens, ids_crc32 as the files hold them, in their order."""
    import public_tokenizers
    from zlib import crc32

    path = f"{shared_dir(spark)}/tollgate/ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id)
    got = read(spark, path, finish=crc32, schema="shard int, block int, start long, doc_id long, n_tokens long, ids_crc32 long")
    return got.join(block_starts(spark, path), ["shard", "block"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


QUERIES = {"op7_token_ids": op7_token_ids}
ORACLES: dict = {}
