"""Backwards links between rows that share an identifier, and sums over them.

A row links to the most recent `cap` earlier rows of its key within the window. A ROWS frame
of cap rows carries them, so there is no self-join and memory per row is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.features import link_key
from .windows import sliced, swept


def linked(key: str, window_s: float, cap: int = 32, payload: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> Column:
    w = Window.partitionBy(*also, key).orderBy("ts_s", "seq").rowsBetween(-cap, -1)
    got = F.collect_list(F.struct("ts_s", "seq", *payload)).over(w)
    return F.when(F.col(key).isNull(), F.slice(got, 1, 0)).otherwise(F.filter(got, lambda x: x["ts_s"] >= F.col("ts_s") - window_s))


def _long(df: DataFrame, relations: tuple[str, ...], also: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    one = [F.struct(F.lit(r).alias("rel"), link_key(df, r).alias("key")) for r in relations]
    return df.select("seq", "ts_s", *also, *more, F.explode(F.array(*one)).alias("x")).select("seq", "ts_s", *also, *more, "x.*").where("key is not null")


def long_links(df: DataFrame, relations: tuple[str, ...], window_s: float, cap: int = 32, also: tuple[str, ...] = ()) -> DataFrame:
    """seq, ts_s, rel, key, l (links): a row for each relation in which a row has a key that marks no absence.

    Unpivoted first so that one shuffle serves all relations and null keys stay out; slices of one window,
    with the slice before copied in, spread a hot key.
    """
    got = sliced(_long(df, relations, also), window_s).withColumn("l", linked("key", window_s, cap, also=("rel", *also, "slice_")))
    return got.where("own_").drop("slice_", "own_")


def edges(df: DataFrame, relations: tuple[str, ...], window_s: float, cap: int = 32) -> DataFrame:
    """rel, src, dst over all relations."""
    return long_links(df, relations, window_s, cap).select("rel", F.explode("l.seq").alias("src"), F.col("seq").alias("dst"))


def _matrix(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An array of lists as a matrix padded on the right, and which of its places hold a value."""
    n = pc.fill_null(pc.list_value_length(a), 0).to_numpy()
    has = np.arange(max(n.max(initial=0), 1)) < n[:, None]
    out = np.zeros(has.shape, np.int64)
    out[has] = a.flatten().to_numpy()
    return out, has


def kept(df: DataFrame, placed: dict[str, Column], relations: tuple[str, ...], window_s: float, cap: int = 32) -> DataFrame:
    """rel, routing, edges, kept: how many links there are, and of how many the ends share a number in `placed`, an array column a routing.

    Links are counted in the tasks that find them, so what leaves a task is a few sums.
    """
    own = [f"at_{i}_" for i in range(len(placed))]
    d = df.withColumns({c: F.array_compact(p.cast("array<bigint>")) for c, p in zip(own, placed.values())})

    def work(t, rows, lo, last):
        rel = np.array(relations)
        of = pc.index_in(t["rel"], pa.array(relations)).to_numpy().astype("i8")
        ends = [_matrix(t[c].chunk(0)) for c in own]
        all_, left = np.zeros(len(rel), "i8"), np.zeros((len(own), len(rel)), "i8")
        for k in range(1, cap + 1):
            rows = rows[rows - k >= lo[rows]]
            if not len(rows):
                break
            all_ += np.bincount(of[rows], minlength=len(rel))
            for j, (x, has) in enumerate(ends):
                if x.shape[1] == 1:
                    same = (x[rows, 0] == x[rows - k, 0]) & has[rows, 0] & has[rows - k, 0]
                else:
                    same = ((x[rows][:, :, None] == x[rows - k][:, None, :]) & has[rows][:, :, None] & has[rows - k][:, None, :]).any(axis=(1, 2))
                left[j] += np.bincount(of[rows[same]], minlength=len(rel))
        return pa.table({"rel": np.tile(rel, len(own)), "routing": pa.array(np.repeat(np.arange(len(own)), len(rel)), pa.int32()), "edges": np.tile(all_, len(own)), "kept": left.ravel()})

    fields = [T.StructField("rel", T.StringType()), T.StructField("routing", T.IntegerType()), T.StructField("edges", T.LongType()), T.StructField("kept", T.LongType())]
    got = swept(sliced(_long(d, relations, more=tuple(own)), window_s), ("rel", "key", "slice_"), window_s, work, fields, cap).groupBy("rel", "routing").agg(F.sum("edges").alias("edges"), F.sum("kept").alias("kept"))
    return got.withColumn("routing", F.get(F.array(*map(F.lit, placed)).cast("array<string>"), F.col("routing")))


def degrees(df: DataFrame, e: DataFrame) -> DataFrame:
    """Links in and out of every row, zeros included."""
    ends = e.select(F.explode(F.array("src", "dst")).alias("seq")).groupBy("seq").agg(F.count("*").alias("d"))
    return df.select("seq").join(ends, "seq", "left").select("seq", F.coalesce("d", F.lit(0)).alias("degree"))


def shared_entity_score(df: DataFrame, relations: tuple[str, ...], window_s: float, cap: int = 32, also: tuple[str, ...] = ()) -> DataFrame:
    """Sum over relations of links / log1p(rows of the key), within groups of `also` (a shard, a tenant)."""
    def work(t, rows, lo, last):
        return t.select(["seq", *also, "rel", "key"]).take(rows).append_column("n_", pa.array(rows - lo[rows]))

    fields = [*[df.schema[c] for c in ("seq", *also)], T.StructField("rel", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n_", T.LongType())]
    long = swept(sliced(_long(df, relations, also), window_s), ("rel", *also, "key", "slice_"), window_s, work, fields, cap)
    per = _long(df, relations, also).where("ts_s is not null").groupBy("rel", *also, "key").agg(F.count("*").alias("rows_"))  # counted before the shuffle, and the sweep has one reader
    s = F.col("n_") / F.log1p(F.col("rows_").cast("double"))
    got = long.where("n_ > 0").join(per, ["rel", *also, "key"]).groupBy("seq", *also).agg(F.sum(s).alias("shared"))
    return df.join(got, ["seq", *also], "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))


def evidence(df: DataFrame, rel: str, window_s: float, cap: int = 32, most: int = 6) -> DataFrame:
    """Of rows with links: the shared value, the newest ids first (at most `most`), and how many there are."""
    got = long_links(df, (rel,), window_s, cap).where(F.size("l") > 0)
    return got.select("seq", F.col("key").cast(df.schema[rel].dataType).alias("value"), F.slice(F.reverse(F.col("l.seq")), 1, most).alias("ids"), F.size("l").alias("total"))


def softmax(att) -> list[float]:
    """Mixing weights of the relations from their learned attention."""
    import math

    top = max(att)
    e = [math.exp(a - top) for a in att]
    return [x / sum(e) for x in e]


def _means(relations: tuple[str, ...], keys: list[str], maps: list[np.ndarray], window_s: float, cap: int, gates: np.ndarray | None):
    """For swept: each own row's mean over its links, which are a stretch of the rows before it, times its relation's matrix."""
    dim, wide = maps[0].shape[1], len(maps[0])

    def work(t, rows, lo, last):
        x = t["v_"].chunk(0).flatten().to_numpy().reshape(-1, dim)
        of = pc.index_in(t["rel"], pa.array(relations)).to_numpy().astype("i8")
        rows = rows[lo[rows] < rows]
        out = np.zeros((len(rows), wide))
        for some in np.array_split(np.arange(len(rows)), -(-len(rows) * cap * dim // (1 << 22))) if len(rows) else ():
            k = rows[some] - lo[rows[some]]
            at = np.cumsum(k) - k
            src = np.arange(k.sum()) - np.repeat(at, k) + np.repeat(lo[rows[some]], k)
            w = np.ones(len(src))
            if gates is not None:
                dst = np.repeat(rows[some], k)
                w = 1 / (1 + np.exp(-(np.abs(x[src] - x[dst]) * gates[of[dst]]).sum(1)))
            mean = np.add.reduceat(x[src] * w[:, None], at) / np.maximum(np.add.reduceat(w, at), 1.0)[:, None]
            for r, m in enumerate(maps):
                mine = of[rows[some]] == r
                out[some[mine]] = mean[mine] @ m.T
        got = t.select(["seq", *keys]).take(rows)
        return got.append_column("z", pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * wide, pa.int32()), pa.array(out.ravel())))

    return work


def message_layer(df: DataFrame, state: str, relations: tuple[str, ...], w_self, bias, w_rel, mix, window_s: float, cap: int = 32, out: str = "h", gate=None, also: tuple[str, ...] = ()) -> DataFrame:
    """ReLU(W_self x + b + sum over relations of mix * W_r m_r), with fixed weights.

    m_r is the mean of the links' vectors; with a gate (a vector a relation) their sum weighted by
    sigmoid(gate . |x_src - x_dst|), over the weights' sum or 1. seq (a long) must be distinct within
    `also`. One shuffle deals all relations' rows by key and slice of a window, with the slice before
    copied in, so hot keys are spread and rows without a key stay out; one brings means back.
    """
    if not len(relations) == len(w_rel) == len(mix):
        raise ValueError("one matrix and one weight a relation")
    own, shift, maps = np.array(w_self, float), np.array(bias, float), [float(m) * np.array(w, float) for w, m in zip(w_rel, mix)]
    dim, wide, gates = own.shape[1], own.shape[0], None if gate is None else np.array(gate, float).reshape(len(relations), -1)
    keys = [f"also_{i}_" for i in range(len(also))]
    d = df.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in zip(keys, also)})
    long = _long(d.withColumn("v_", F.col(state).cast("array<double>")), relations, tuple(keys), ("v_",))
    fields = [df.schema["seq"], *[T.StructField(k, T.StringType()) for k in keys], T.StructField("z", T.ArrayType(T.DoubleType()))]
    means = swept(sliced(long, window_s), ("rel", *keys, "key", "slice_"), window_s, _means(tuple(relations), keys, maps, window_s, cap, gates), fields, cap)
    means = means.groupBy("seq", *keys).agg(F.flatten(F.collect_list("z")).alias("zs_"))

    @F.arrow_udf("array<double>")
    def combined(x: pa.Array, zs: pa.Array) -> pa.Array:
        z = x.flatten().to_numpy().reshape(len(x), dim) @ own.T + shift
        n = pc.fill_null(pc.list_value_length(zs), 0).to_numpy() // wide  # relations that a row has means in
        np.add.at(z, np.repeat(np.arange(len(x)), n), zs.flatten().to_numpy().reshape(-1, wide))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * wide, pa.int32()), pa.array(np.maximum(z, 0).ravel()))

    return d.join(means, ["seq", *keys], "left").withColumn(out, combined(F.col(state).cast("array<double>"), "zs_")).drop(*keys, "zs_")
