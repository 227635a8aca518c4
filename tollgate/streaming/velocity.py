"""Streaming counts by event time: replay in micro-batches over a state table, quarantine, sliding counts.

`rings` scores by order of arrival instead. Here late rows are scored, never dropped, among the rows that are earlier in time and still held. State older than the
window behind the largest event time seen is left out of the next state table. The state
is a Parquet table in the checkpoint folder, a new version per batch, so a restarted batch
reads the version it started from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.features import entity_key, reasons
from ..operators.links import linked
from ..operators.windows import trailing_count


def state(spark, folder: str, batch: int) -> DataFrame | None:
    """The state table that a batch starts from; none for the first."""
    return spark.read.parquet(f"{folder}/v{batch}") if batch else None


class TrailingCounts:
    """foreachBatch body: trailing count per key over state and batch; quarantined rows go to a side sink."""

    def __init__(self, state_dir: str, out_dir: str, key: str, window_s: float):
        self.state_dir, self.out_dir, self.key, self.window_s = state_dir, out_dir, key, window_s

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        why = reasons(batch)
        good, bad = batch.where(F.size(why) == 0), batch.where(F.size(why) > 0)
        bad.withColumn("reasons", why).write.mode("overwrite").parquet(f"{self.out_dir}/quarantine/batch={batch_id}")
        old = state(spark, self.state_dir, batch_id)
        cols = good.columns
        all_ = good.withColumn("new_", F.lit(True))
        if old is not None:
            all_ = all_.unionByName(old.select(*cols).withColumn("new_", F.lit(False)))
        got = all_.withColumn("key_", entity_key(F.col(self.key)))  # null where the value only marks absence
        got = got.withColumn("count", F.when(F.col("key_").isNotNull(), trailing_count("key_", self.window_s)).otherwise(0)).withColumn("links", F.size(linked("key_", self.window_s)))
        got.where("new_").drop("new_", "key_").write.mode("overwrite").parquet(f"{self.out_dir}/scored/batch={batch_id}")
        high = all_.agg(F.max("ts_s")).first()[0]  # one number
        keep = all_.where(F.col("ts_s") >= (high if high is not None else 0.0) - self.window_s).drop("new_")
        keep.write.mode("overwrite").parquet(f"{self.state_dir}/v{batch_id + 1}")


def replay(stream: DataFrame, checkpoint: str, state_dir: str, out_dir: str, key: str, window_s: float):
    """Run a stream of attempts to its end, with trailing counts of a key."""
    return run(stream, checkpoint, TrailingCounts(state_dir, out_dir, key, window_s))


def run(stream: DataFrame, checkpoint: str, body):
    """Run a stream of attempts to its end through a foreachBatch body."""
    q = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def sliding_counts(df: DataFrame, rel: str, window_s: float, slices: int = 8) -> DataFrame:
    """Rows of each value in the current and the slices - 1 earlier slices of a window: what a
    sliding sketch estimates, exactly, from counts by (value, slice)."""
    width = window_s / slices
    per = df.where(entity_key(F.col(rel)).isNotNull()).groupBy(entity_key(F.col(rel)).alias("value"), F.floor(F.col("ts_s") / width).alias("slice")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("value").orderBy("slice").rangeBetween(-(slices - 1), 0)
    return per.withColumn("count", F.sum("n").over(w))
