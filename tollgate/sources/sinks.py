"""Result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """One experiment's (small) result as one CSV part with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def replay_subset(df: DataFrame, first: float, low: float = -60.0, high: float = 120.0, wide: tuple[float, float] = (-300.0, 3900.0), stride: int = 4, slice_s: float = 3600.0) -> DataFrame:
    """All labelled rows, all rows near the first alert, and every stride-th other row of a wider band.

    The counter runs over the other rows in time order; it is kept by slices of time, with
    the slices' totals added, so no task orders the whole stream.
    """
    rel = F.col("ts_s") - F.lit(first)
    near = (F.col("label") == 1) | rel.between(low, high)
    rest = df.where(~near & rel.between(*wide)).withColumn("slice_", F.floor(F.col("ts_s") / slice_s))
    n = rest.groupBy("slice_").agg(F.count("*").alias("n_"))
    base = n.withColumn("base_", F.sum("n_").over(Window.orderBy("slice_")) - F.col("n_")).drop("n_")
    rest = rest.withColumn("rn_", F.row_number().over(Window.partitionBy("slice_").orderBy("ts_s", "seq"))).join(base, "slice_")
    return df.where(near).unionByName(rest.where((F.col("rn_") + F.col("base_") - 1) % stride == 0).select(*df.columns))
