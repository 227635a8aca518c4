"""Helpers shared by the operators: shared-storage cuts, components, reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


_held: dict = {}


def held(key, make):
    """What make() gives, kept in this worker process between tasks until another key's takes its place,
    so a worker that serves several operators holds the memo of one at a time."""
    if key not in _held:
        import pyarrow as pa

        _held.clear()
        pa.default_memory_pool().release_unused()  # what Arrow keeps of batches that are gone
        _held[key] = make()
    return _held[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one in local mode and an
    error on a cluster, whose executors would not see it."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got is None:
        got = spark.sparkContext.getCheckpointDir()
    if got is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tollgate-"))
        got = spark.sparkContext.getCheckpointDir()
    return got.rstrip("/")


def cut(df: DataFrame, name: str = "cut", *by: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage ends there,
    lost executors cost no recomputation, and later readers prune columns. Rows lie in a folder for each value of `by`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tollgate/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by) or None)
    out = spark.read.schema(df.schema).parquet(path)
    out.tollgate_path = path
    return out


def drop_cut(df: DataFrame, part: str = ".") -> None:
    """Delete the files behind a frame made by cut(), or one folder of them, that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{df.tollgate_path}/{part}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star contraction.

    edges has two long columns; nulls and loops are ignored. Returns node, component
    (smallest node reachable) for every node with an edge. The work per round is one
    aggregation and one join over the edges that remain, at most one row per edge; no
    neighbour list is ever gathered, so a node with any number of edges is no
    bottleneck (AQE splits its join partition). Joins are sort merges whatever Spark takes
    a side's size for, so nothing passes through the driver.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        # Done if every node is either a centre or has one edge to a centre.
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        ends = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        if ends.where("up > 1 or up > 0 and down > 0").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.*")
        new = cut(small.where("u != v").distinct(), "edges")
        drop_cut(e)
        e = new
    else:
        raise RuntimeError("components: no fixed point; raise rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
