"""Trailing windows: inclusive at the far edge, by row at the near one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.features import link_key

#: Rows that a step of a sweep takes at least, of a task's sorted rows.
STEP_ROWS = 1 << 16


def _span(agg: str, keys: list[str], window_s: float, ts: str = "ts_s") -> Column:
    """agg over [ts - window, ts] of the keys; the window may be a fraction of a second."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return F.expr(f"{agg} OVER ({part}ORDER BY {ts} RANGE BETWEEN {float(window_s)!r}D PRECEDING AND CURRENT ROW)")


def trailing_count(key, window_s: float, seq: str | list[str] = "seq", ts: str = "ts_s") -> Column:
    """Rows of the key in [ts - window, this row]: a range count without the tied rows that come later."""
    seq = [seq] if isinstance(seq, str) else seq
    keys = [key] if isinstance(key, str) else list(key)
    tied = Window.partitionBy(*keys, ts)
    return _span("count(*)", keys, window_s, ts) - F.count("*").over(tied) + F.row_number().over(tied.orderBy(*seq))


def counts_by_entity(df: DataFrame, entities: tuple[str, ...], window_s: float) -> DataFrame:
    """seq, entity, c: the trailing count of each identifier that a row has.

    One shuffle serves all entities; identifiers that mark absence never enter it, and a key's rows are
    dealt by slices of the window, so a hot key is spread over its slices.
    """
    one = [F.struct(F.lit(e).alias("entity"), link_key(df, e).alias("key")) for e in entities]
    long = df.select("seq", "ts_s", F.explode(F.array(*one)).alias("x")).select("seq", "ts_s", "x.*").where("key is not null")

    def work(t, rows, lo, last):
        return pa.table({"seq": t["seq"].take(rows), "entity": t["entity"].take(rows), "c": rows - lo[rows] + 1})

    fields = [T.StructField("seq", df.schema["seq"].dataType), T.StructField("entity", T.StringType()), T.StructField("c", T.LongType())]
    return swept(sliced(long, window_s), ("entity", "key", "slice_"), window_s, work, fields)


def velocity(df: DataFrame, key: str, tau: int, window_s: float, seq="seq") -> Column:
    return F.when(F.col(key).isNull(), 0).otherwise(F.greatest(trailing_count(key, window_s, seq) - tau, F.lit(0)))


def multi_velocity(df: DataFrame, taus: dict[str, int], window_s: float, counts: DataFrame | None = None) -> DataFrame:
    """df with velocity: the most that any entity's trailing count exceeds its threshold by; counts may be given."""
    c = counts_by_entity(df, tuple(taus), window_s) if counts is None else counts
    over = sum((F.when(F.col("entity") == e, F.greatest(F.col("c") - t, F.lit(0))).otherwise(0) for e, t in taus.items()), F.lit(0))
    best = c.groupBy("seq").agg(F.max(over).alias("velocity"))
    return df.join(best, "seq", "left").withColumn("velocity", F.coalesce("velocity", F.lit(0)))


def tune_velocity(df: DataFrame, entities: tuple[str, ...], window_s: float, budget: float = 0.01, counts: DataFrame | None = None) -> DataFrame:
    """Per entity the least tau of 2 or more whose share of rows above it is within budget / entities.

    One histogram of counts per entity; its size is that of distinct counts, not of rows.
    """
    n = df.count()
    counts = counts_by_entity(df, entities, window_s) if counts is None else counts
    hist = counts.groupBy("entity", "c").agg(F.count("*").alias("m"))
    two = _two(df).select(F.explode(F.array(*map(F.lit, entities))).alias("entity"), "c", "m")
    # A tau between two counts passes as the lower count does.
    hist = hist.unionByName(two).groupBy("entity", "c").agg(F.sum("m").alias("m"))
    above = F.coalesce(F.sum("m").over(Window.partitionBy("entity").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ok = (F.col("c") >= 2) & (F.col("above") / F.lit(float(max(n, 1))) <= budget / len(entities))
    return hist.withColumn("above", above).where(ok).groupBy("entity").agg(F.min("c").cast("long").alias("tau"))


def _two(df: DataFrame) -> DataFrame:
    """Count 2 with no rows: the least threshold is always a candidate."""
    return df.sparkSession.range(1).select(F.lit(2).cast("long").alias("c"), F.lit(0).cast("long").alias("m"))


def sliced(df: DataFrame, window_s: float, ts: str = "ts_s") -> DataFrame:
    """Rows by slices of one window, each with the rows of the slice before it as copies."""
    s = F.floor(F.col(ts) / window_s)
    return df.withColumn("slice_", F.explode(F.array(s, s + 1))).withColumn("own_", F.col("slice_") == s)


def swept(d: DataFrame, by: tuple[str, ...], window_s: float, work, fields: list, cap: int | None = None) -> DataFrame:
    """What work(t, rows, lo, last) gives, called along the sorted rows of each task: rows of the Arrow table t are in
    order of (by, ts_s, seq), `rows` are the own ones due, lo has every row's first one in its window (and among the
    newest cap before it), last the last one of its time.

    A frame of Spark's over a range is summed anew for every row, so its work is a key's rows times those in a window,
    and holds the frame as objects. Here each bound is a search in columns of numbers, and a task holds
    the columns of a step and of the window before it.
    """
    schema, least = T.StructType(fields), STEP_ROWS

    def step(t, done: int, final: bool):
        t = t.combine_chunks()
        n, ts = t.num_rows, t["ts_s"].to_numpy()
        new = np.zeros(n, bool)
        new[0] = True
        for c in by:
            col = t[c].chunk(0)
            a, b = col.slice(1), col.slice(0, n - 1)
            new[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        lo = np.flatnonzero(new)[np.cumsum(new) - 1]
        if cap is not None:
            lo = np.maximum(lo, np.arange(n) - cap)
        new[1:] |= ts[1:] != ts[:-1]
        runs = np.flatnonzero(new)
        last = np.append(runs[1:], n)[np.cumsum(new) - 1] - 1
        hi, edge = np.arange(n), ts - window_s
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            before = ts[mid] < edge
            lo, hi = np.where(open_ & before, mid + 1, lo), np.where(open_ & ~before, mid, hi)
        stop = n if final else int(runs[-1])  # rows wait until all of their time are there
        rows = np.flatnonzero(t["own_"].to_numpy()[done:stop]) + done
        out = work(t, rows, lo, last) if len(rows) else None
        keep = n if final else int(lo[stop])
        return out, t.slice(keep), stop - keep

    def run(batches):
        held, done, more, size = None, 0, [], 0
        for b in batches:
            more.append(b)
            size += b.num_rows
            if size >= max(least, 0 if held is None else held.num_rows // 2):
                out, held, done = step(pa.Table.from_batches([*(held.to_batches() if held is not None else []), *more]), done, False)
                more, size = [], 0
                if out is not None:
                    yield from out.to_batches(max_chunksize=1 << 16)
        left = [*(held.to_batches() if held is not None else []), *more]
        if sum(b.num_rows for b in left):
            out = step(pa.Table.from_batches(left), done, True)[0]
            if out is not None:
                yield from out.to_batches(max_chunksize=1 << 16)

    return d.where("ts_s is not null").repartition(*by).sortWithinPartitions(*by, "ts_s", "seq").mapInArrow(run, schema)


def _swept_stream(df: DataFrame, flag: Column, window_s: float, peers: bool, more: dict, of) -> DataFrame:
    """df with the columns `more` (name: type) that of(ts, flags before each row, positions of flags, rows, lo, hi) gives by slices of the whole stream."""
    names = df.columns

    def work(t, rows, lo, last):
        a = pc.fill_null(t["flag_"], False).to_numpy().astype(bool)
        got = of(t["ts_s"].to_numpy(), np.r_[0, np.cumsum(a)], np.flatnonzero(a), rows, lo[rows], last[rows] if peers else rows)
        out = t.select(names).take(rows)
        for name, x in zip(more, got):
            out = out.append_column(name, x if isinstance(x, pa.Array) else pa.array(x))
        return out

    fields = [*df.schema.fields, *[T.StructField(n, t) for n, t in more.items()]]
    return swept(sliced(df.withColumn("flag_", flag.cast("boolean")), window_s), ("slice_",), window_s, work, fields)


def trailing_rate(df: DataFrame, flag: Column, window_s: float, peers: bool = False) -> DataFrame:
    """Share of flagged rows of the whole stream in [ts - window, this row]; no task holds the stream.

    With peers, all rows of this row's time count, also those after it.
    """
    def of(ts, before, at, rows, lo, hi):
        return [(before[hi + 1] - before[lo]) / (hi - lo + 1)]

    return _swept_stream(df, flag, window_s, peers, {"rate": T.DoubleType()}, of)


def ring_summary(df: DataFrame, alert: Column, window_s: float, peers: bool = False) -> DataFrame:
    """Alerts in the trailing window of the whole stream up to this row (with peers: all of its time), the first one's time, and the seconds since it."""
    def of(ts, before, at, rows, lo, hi):
        n = before[hi + 1] - before[lo]
        first = np.zeros(len(rows))
        first[n > 0] = ts[at[before[lo][n > 0]]]
        return [n, pa.array(first, mask=n == 0), pa.array(ts[rows] - first, mask=n == 0)]

    return _swept_stream(df, alert, window_s, peers, {"alerts": T.LongType(), "first_alert_s": T.DoubleType(), "since_s": T.DoubleType()}, of)


def interarrival(df: DataFrame, slice_s: float = 86_400.0) -> DataFrame:
    """Gap to the row before, by slices; a slice's first row looks at the last time before it."""
    d = df.withColumn("slice_", F.floor(F.col("ts_s") / slice_s))
    last = d.groupBy("slice_").agg(F.max("ts_s").alias("m_"))
    before = last.withColumn("before_", F.max("m_").over(Window.orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1))).drop("m_")
    w = Window.partitionBy("slice_").orderBy("ts_s", "seq")
    return d.join(before, "slice_").withColumn("gap_s", F.col("ts_s") - F.coalesce(F.lag("ts_s").over(w), "before_", "ts_s")).drop("slice_", "before_")
