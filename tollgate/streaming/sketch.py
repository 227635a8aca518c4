"""A sliding count-min sketch as a table: estimates never fall below the true count.

The window is parted into slices; each slice has depth rows of width counters. As a table
(slice, d, bucket, n) it has depth * width * slices rows at most, whatever the stream, and
tables of parts of a stream add up. The live span is slices - 1 whole slices and the current one.
`shares` keeps the same counters in a stateful operator: an array a relation and depth, changed in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.features import entity_key

WIDTH, DEPTH, SLICES = 2048, 4, 8


def _cells(value: Column, width: int, depth: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.pmod(F.xxhash64(F.lit(d), value.cast("string")), F.lit(width)).cast("int").alias("bucket")) for d in range(depth)]))


def build(df: DataFrame, rel: str, window_s: float, width: int = WIDTH, depth: int = DEPTH, slices: int = SLICES) -> DataFrame:
    """slice, d, bucket, n of the rows that have the identifier."""
    at = F.floor(F.col("ts_s") / (window_s / slices)).alias("slice")
    key = entity_key(F.col(rel))  # values that mark absence are not counted
    cells = df.where(key.isNotNull()).select(at, _cells(key, width, depth).alias("c"))
    return cells.groupBy("slice", "c.d", "c.bucket").agg(F.count("*").alias("n"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("slice", "d", "bucket").agg(F.sum("n").alias("n"))


def live(sketch: DataFrame, at_s: float, window_s: float, slices: int = SLICES) -> DataFrame:
    """The slices still counted at a time."""
    now = int(np.floor(at_s / (window_s / slices)))
    return sketch.where(F.col("slice").between(now - slices + 1, now))


def estimate(sketch: DataFrame, values: DataFrame, rel: str, at_s: float, window_s: float, width: int = WIDTH, depth: int = DEPTH, slices: int = SLICES) -> DataFrame:
    """value, estimate for the distinct values of a column: the least of its counters' sums, 0 where one is empty."""
    sums = live(sketch, at_s, window_s, slices).groupBy("d", "bucket").agg(F.sum("n").alias("n"))  # depth * width rows at most
    v = values.select(entity_key(F.col(rel)).alias("value")).where("value is not null").distinct()
    cells = v.select("value", _cells(F.col("value"), width, depth).alias("c")).select("value", "c.*")
    return cells.join(F.broadcast(sums), ["d", "bucket"], "left").groupBy("value").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def total(sketch: DataFrame, at_s: float, window_s: float, slices: int = SLICES) -> DataFrame:
    """All rows counted at a time: one depth's sum."""
    return live(sketch, at_s, window_s, slices).where("d = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def memory_bytes(width: int = WIDTH, depth: int = DEPTH, slices: int = SLICES) -> int:
    return width * depth * slices * 8


ESTIMATED = "seq long, rel string, d int, estimate long, total long"


class Counters(StatefulProcessor):
    """Keyed by (rel, d): one depth of a relation's sketch. State is one array of slices x width counters, whatever the stream.

    Rows go in by arrival; each gets its value's count over the live slices at its own time, itself
    included. A slice is zeroed when a later one takes its place; a row older than the slice that
    holds its place counts nowhere, as it is out of every later window.
    """

    def __init__(self, window_s: float, width: int = WIDTH, slices: int = SLICES):
        self.width, self.slices, self.slice_s = width, slices, window_s / slices

    def init(self, handle) -> None:
        self.state = handle.getValueState("counters", "epochs array<bigint>, totals array<bigint>, cells binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values("seq")
        old = self.state.get()
        if old:
            epochs, totals = np.array(old[0], "i8"), np.array(old[1], "i8")
            cells = np.frombuffer(bytes(old[2]), "<i4").reshape(self.slices, self.width).copy()
        else:
            epochs, totals, cells = np.full(self.slices, -1 << 62), np.zeros(self.slices, "i8"), np.zeros((self.slices, self.width), "<i4")
        got = []
        for epoch, bucket in zip((d["ts_s"] // self.slice_s).astype("i8").tolist(), d["bucket"].tolist()):
            at = epoch % self.slices
            if epochs[at] < epoch:
                cells[at], totals[at], epochs[at] = 0, 0, epoch
            if epochs[at] == epoch:
                cells[at, bucket] += 1
                totals[at] += 1
            live = epoch - epochs < self.slices
            got.append((int(cells[live, bucket].sum()), int(totals[live].sum())))
        self.state.update((epochs.tolist(), totals.tolist(), cells.tobytes()))
        yield pd.DataFrame({"seq": d["seq"], "rel": key[0], "d": key[1], "estimate": [x[0] for x in got], "total": [x[1] for x in got]})

    def close(self) -> None:
        pass


def _least(frames):
    """The least estimate of a row's depths; they are of one micro-batch and partition."""
    d = list(frames)
    if d and sum(map(len, d)):
        yield pd.concat(d).groupby(["seq", "rel"], as_index=False).agg({"estimate": "min", "total": "max"})[["seq", "rel", "estimate", "total"]]


def shares(stream: DataFrame, relations: tuple[str, ...], window_s: float, width: int = WIDTH, depth: int = DEPTH, slices: int = SLICES) -> DataFrame:
    """seq, rel, estimate, total of a stream's rows: how often each one's values were seen in the window, and rows that had any, as of its arrival."""
    one = [F.struct(F.lit(r).alias("rel"), entity_key(F.col(r)).alias("value")) for r in relations]
    long = stream.select("seq", "ts_s", F.explode(F.array(*one)).alias("x")).where("x.value is not null").select("seq", "ts_s", "x.rel", _cells(F.col("x.value"), width, depth).alias("c"))
    got = long.select("seq", "ts_s", "rel", "c.d", "c.bucket").groupBy("rel", "d").transformWithStateInPandas(Counters(window_s, width, slices), ESTIMATED, "Append", "None")
    return got.repartition("seq").mapInPandas(_least, "seq long, rel string, estimate long, total long")
