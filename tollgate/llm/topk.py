"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's score for a query is a sum over blocks of dimensions; each block is one list
of partial scores. Phase one takes every list's local best k per partition and resolves
them; the k-th best of those totals is a lower bound t on the k-th best score. Phase two
broadcasts t / lists: whoever is below it in every list is below t in total, and is not
collected. Phase three resolves the collected entries' totals exactly, in the task that holds
them.

Queries go in blocks of a fixed number, so what is broadcast has a fixed size; each block
is two passes over the vectors. A pass emits at most k rows per query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, table

OUT = "query_id long, vec_id long, score long"
LONG = 2**63 - 1


def scaled(scale: int):
    """The vector as doubles floor(scale * x); null if null, empty or not all finite."""
    def of(c):
        ok = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
        return F.when(ok, F.transform(c, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double")))
    return of


def _matrix(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, x in enumerate(rows):
        n = min(dim, len(x))
        out[i, :n] = x[:n]
    return out


def _dot(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products; where doubles can't hold them, Python integers held to a long's range."""
    top = (np.abs(q).max(initial=0) or 1) * (np.abs(v).max(initial=0) or 1) * max(q.shape[1], 1)
    if top < 2**52:
        return q @ v.T
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in v], object).T
    return np.vectorize(lambda x: max(-LONG, min(LONG, x)), otypes=[object])(exact)


class _Best:
    """The k best (query, id, score) of each query, ties to the smaller id; pending rows are folded in now and then."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, query, vid, score) -> None:
        self.parts.append((query, vid, score))
        self.size += len(query)
        if self.size > 1 << 20:
            self.fold()

    def fold(self):
        query, vid, score = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((vid, -score, query))
        query, vid, score = query[order], vid[order], score[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        keep = rank < self.k
        self.parts = [(query[keep], vid[keep], score[keep])]
        self.size = 0  # what is kept is bounded by queries * k
        return self.parts[0]


def collected(partial: list[np.ndarray], k: int, cutoff: np.ndarray | None):
    """Which entries the lists hand in: without a cutoff each list's best k + 1 of every query (one may be the
    query itself), else those of cutoff / lists or more."""
    take = np.zeros(partial[0].shape, bool)
    for p in partial:
        if cutoff is not None:
            take |= p >= (cutoff / len(partial))[:, None]
            continue
        n = min(k + 1, p.shape[1])
        at = np.argpartition(-p, n - 1, axis=1)[:, :n] if p.dtype != object else np.argsort(-p, axis=1)[:, :n]
        np.put_along_axis(take, at, True, axis=1)
    return take


def _pass(ids, q, k: int, lists: int, cutoff=None):
    """mapInPandas body. Without cutoff: phase one; with it: phases two and three. Totals are resolved
    for collected entries only; a task gives at most k rows a query."""
    blocks = np.array_split(np.arange(q.shape[1]), min(lists, max(q.shape[1], 1)))

    def run(frames: Iterator[pd.DataFrame]):
        best = _Best(k)
        for f in frames:
            for lo in range(0, len(f), 2048):
                part = f.iloc[lo:lo + 2048]
                v, vid = _matrix(part["v"].tolist(), q.shape[1]), part["vec_id"].to_numpy()
                for qa in range(0, len(ids), 512):
                    qs, qi = q[qa:qa + 512], ids[qa:qa + 512]
                    partial = [_dot(qs[:, b], v[:, b]) for b in blocks]
                    t = None if cutoff is None else cutoff[qa:qa + 512]
                    i, j = np.nonzero(collected(partial, k, t) & (qi[:, None] != vid[None, :]))
                    total = sum((p[i, j] for p in partial[1:]), partial[0][i, j])
                    if t is not None:
                        ok = (total >= t[i]).astype(bool)
                        i, j, total = i[ok], j[ok], total[ok]
                    if len(i):
                        best.add(qi[i], vid[j], np.clip(total, -LONG, LONG).astype("int64"))
        query, vid, score = best.fold()
        yield pd.DataFrame({"query_id": query, "vec_id": vid, "score": score})
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
          vec_col: str = "embedding", lists: int = 4, block: int = 16384) -> DataFrame:
    """Each query's k best vectors of another id: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id. Rows with a null id, and vectors that are null, empty or hold a
    null or non-finite component, take no part. A shorter vector counts as padded with zeros.
    Several rows of one id: as candidates each is a row of its own; as a query the smallest
    vector stands for the id; no id is its own candidate. Scores beyond a long are held to
    its range. An empty table gives no rows. block bounds the queries broadcast at once.
    """
    spark = vectors.sparkSession
    use = scaled(scale)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), use(F.col(vec_col)).alias("v")).where("vec_id is not null and v is not null")
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), use(F.col(vec_col)).alias("v")).where("query_id is not null and v is not null")
    q = cut(q.groupBy("query_id").agg(F.min("v").alias("v"), F.max(F.size("v")).alias("dim")), "queries")
    out, after = None, None
    while True:
        rest = q if after is None else q.where(F.col("query_id") > after)
        rows = rest.orderBy("query_id").limit(block).collect()  # at most block rows: the pass's broadcast
        if not rows:
            break
        after = rows[-1]["query_id"]
        dim = max(max(r["dim"] for r in rows), 1)
        ids, m = np.array([r["query_id"] for r in rows]), _matrix([r["v"] for r in rows], dim)
        first = v.mapInPandas(_pass(ids, m, k, lists), OUT)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        low = {r["query_id"]: r["score"] for r in first.withColumn("n", F.row_number().over(w)).where(F.col("n") == k).select("query_id", "score").collect()}
        cutoff = np.array([float(low.get(int(i), -np.inf)) for i in ids])  # fewer than k others: everything is wanted
        got = v.mapInPandas(_pass(ids, m, k, lists, cutoff), OUT)
        got = got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        got = cut(got.select("query_id", "rank", "vec_id", "score"), "topk")
        out = got if out is None else out.unionByName(got)
        if len(rows) < block:
            break
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op1_exact_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(e, e.where(F.col("vec_id") % 100 == 0), k=10)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
QUERIES = {"op1_exact_topk": op1_exact_topk}
ORACLES = {"op1_exact_topk": ORACLE}
