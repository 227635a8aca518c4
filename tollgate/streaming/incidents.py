"""Online incidents: alerts join over shared values as they arrive; what is written is a log of merges.

A first operator counts every row's values in fixed memory (sketch.Counters). A second one, keyed by
(relation, value), holds one row for each component that the value ties within the link window
and emits links of new alerts to them. Links are appended, a folder a batch, so a batch writes in
proportion to its alerts; `compact` shortens the log's paths to one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.features import entity_key
from ..operators.components import label
from . import sketch

#: Counters a row of each relation's sketch.
WIDTH = 4096
LINKS = "was long, to long, skipped boolean"


class Ties(StatefulProcessor):
    """Keyed by (rel, key): links of each alert to the components met through this value no more than gap_s before it.

    All alerts that one value tied are one component already, so state is a row for each: a member
    and the latest time, gone for good once an alert comes more than gap_s after it. A value too common at an alert's arrival ties nothing then; the alert waits
    as a component of its own. Silent keys go after ttl_s of processing time.
    """

    def __init__(self, gap_s: float, share: float, ttl_s: float | None = None):
        self.gap_s, self.share, self.ttl_s = gap_s, share, ttl_s

    def init(self, handle) -> None:
        self.open = handle.getValueState("open", "member array<bigint>, ts array<double>", *([int(self.ttl_s * 1000)] if self.ttl_s else []))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values("seq")
        if key[0] == "":  # an alert itself
            yield pd.DataFrame({"was": d["seq"], "to": d["seq"], "skipped": False})
            return
        old = self.open.get()
        parts = list(zip(*old)) if old else []
        out = []
        for seq, ts, common in zip(d["seq"].tolist(), d["ts_s"].tolist(), (d["estimate"] > self.share * d["total"]).tolist()):
            parts = [p for p in parts if p[1] >= ts - self.gap_s]
            if common:
                parts.append((seq, ts))
                out.append((seq, seq, True))
            else:
                out += [(seq, int(m), False) for m, _ in parts]
                parts = [(seq, max([ts, *(t for _, t in parts)]))]
        self.open.update(([int(m) for m, _ in parts], [float(t) for _, t in parts]))
        yield pd.DataFrame(out, columns=["was", "to", "skipped"]).astype({"was": "int64", "to": "int64", "skipped": "bool"})

    def close(self) -> None:
        pass


def ties(stream: DataFrame, relations: tuple[str, ...], threshold: float, gap_s: float = 900.0, share: float = 0.02, window_s: float = 3600.0, ttl_s: float | None = None, width: int = WIDTH) -> DataFrame:
    """was, to, skipped: the merge log of a stream of attempts with seq (arrival), ts_s, score and the relations.

    An alert comes with a row of its own (was = to). All rows count towards how common a value is, of
    those in the window that have a value; values that mark absence neither count nor tie.
    """
    one = [F.struct(F.lit(r).alias("rel"), entity_key(F.col(r)).alias("key")) for r in relations]
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.pmod(F.xxhash64(F.lit(d), "x.key"), F.lit(width)).cast("int").alias("bucket")) for d in range(sketch.DEPTH)]))
    alert = F.coalesce((F.col("score") >= threshold) & ~F.isnan("score"), F.lit(False))
    rows = stream.select("seq", "ts_s", alert.alias("alert"), F.explode(F.concat(F.array(F.struct(F.lit("").alias("rel"), F.pmod(F.xxhash64("seq"), F.lit(64)).cast("string").alias("key"))), F.array(*one))).alias("x"))
    long = rows.where("x.key is not null").select("seq", "ts_s", "alert", "x.rel", "x.key", cells.alias("c")).select("seq", "ts_s", "alert", "rel", "key", "c.d", "c.bucket")
    counted = long.groupBy("rel", "d").transformWithStateInPandas(_Shares(window_s, width), SHARED, "Append", "None")
    alerts = counted.repartition("seq").mapInPandas(_least, "seq long, ts_s double, rel string, key string, estimate long, total long")
    return alerts.groupBy("rel", "key").transformWithStateInPandas(Ties(gap_s, share, ttl_s), LINKS, "Append", "ProcessingTime" if ttl_s else "None")


SHARED = "seq long, ts_s double, rel string, key string, d int, estimate long, total long"


class _Shares(sketch.Counters):
    """The sketch's counts of alerts alone, with their time and key; the rows that stand for alerts themselves are not counted."""

    def handleInputRows(self, key, rows, timers):
        d = pd.concat(list(rows)).sort_values("seq")
        got = d.assign(estimate=0, total=0) if key[0] == "" else d.merge(pd.concat(list(super().handleInputRows(key, iter([d]), timers)))[["seq", "estimate", "total"]], on="seq")
        yield got[got["alert"]][[c.split()[0] for c in SHARED.split(", ")]]


def _least(frames):
    d = list(frames)
    if d and sum(map(len, d)):
        yield pd.concat(d).groupby(["seq", "rel"], as_index=False).agg({"ts_s": "first", "key": "first", "estimate": "min", "total": "max"})[["seq", "ts_s", "rel", "key", "estimate", "total"]]


class MergeLog:
    """foreachBatch body and reader of a merge log: links/batch=N for each batch, groups/upto=N after a compaction."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, links: DataFrame, batch_id: int) -> None:
        links.write.mode("overwrite").parquet(f"{self.folder}/links/batch={batch_id}")

    def _upto(self, spark) -> int:
        """The last batch that a compaction took in; -1 before the first."""
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/groups")
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [s.getPath() for s in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
        return max((int(p.getName().split("=")[1]) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=-1)

    def _links(self, spark) -> DataFrame:
        return spark.read.schema(f"{LINKS}, batch int").parquet(f"{self.folder}/links")

    def groups(self, spark) -> DataFrame:
        """seq, component (least member) of every alert so far, from the compacted log and the batches since."""
        upto = self._upto(spark)
        log = self._links(spark).where(F.col("batch") > upto).select("was", "to")
        if upto >= 0:
            log = log.unionByName(spark.read.parquet(f"{self.folder}/groups/upto={upto}").select(F.col("seq").alias("was"), F.col("component").alias("to")))
        # A link is a group of two; label gives every member the least of its component.
        ends = log.withColumn("grp", F.concat_ws(">", "was", "to")).select(F.explode(F.array("was", "to")).alias("seq"), "grp").distinct()
        return label(ends)

    def compact(self, spark, batch_id: int) -> None:
        """Write every alert's component as of a finished batch; later reads follow one step from there."""
        if batch_id > self._upto(spark):
            old = MergeLog(self.folder)
            old._links = lambda s: self._links(s).where(F.col("batch") <= batch_id)
            old.groups(spark).write.mode("overwrite").parquet(f"{self.folder}/groups/upto={batch_id}")

    def stats(self, spark) -> dict:
        g = self.groups(spark).agg(F.count("*").alias("alerts"), F.count_distinct("component").alias("incidents")).first()
        return {**g.asDict(), "links_skipped_as_common": self._links(spark).where("skipped").count()}


def run(stream: DataFrame, folder: str, checkpoint: str, relations: tuple[str, ...], threshold: float, **how) -> MergeLog:
    """Consolidate a stream to its end; returns the log."""
    log = MergeLog(folder)
    q = ties(stream, relations, threshold, **how).writeStream.foreachBatch(log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return log
