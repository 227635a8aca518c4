"""Attempt tables: the fixed contract and adapters from other tables to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RELATIONS = ("device_id", "ip_id", "bin_id", "email_domain")
MODEL_RELATIONS = ("device_id", "ip_id", "bin_id")
COLUMNS = ("seq", "ts_s", "amount", "card_id", "bin_id", "device_id", "ip_id", "email_domain", "approved", "label", "campaign_id", "score")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts from the event stream; label, campaign and score are fixed functions of ids."""
    e = table(spark, sf_dir, "events")
    hit = F.col("user_id") % 7 == 0
    return e.select(
        F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts_s"), F.col("value").alias("amount"),
        F.col("event_id").cast("string").alias("card_id"), F.concat(F.lit("b"), F.col("event_id") % 40).alias("bin_id"), F.concat(F.lit("d"), "user_id").alias("device_id"),
        F.concat(F.lit("i"), F.regexp_extract("props", "[0-9]+", 0)).alias("ip_id"), F.col("event_type").alias("email_domain"), (F.col("event_type") != "error").alias("approved"),
        hit.cast("int").alias("label"), F.when(hit, F.concat(F.lit("c"), F.col("user_id") % 3)).alias("campaign_id"), ((F.col("event_id") * 7919 % 1000) / F.lit(1000.0)).alias("score"))


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts from order lines: day-granular times, so heavy ties; tie carries the order within a time."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    got = l.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"), "l_orderkey")
    return got.select(
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(1e6)).alias("ts_s"), F.col("l_extendedprice").alias("amount"), F.col("o_custkey").alias("device_id"),
        F.col("l_partkey").alias("ip_id"), F.col("l_suppkey").alias("bin_id"), F.col("o_orderpriority").alias("email_domain"), (F.col("l_returnflag") != "R").alias("approved"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("seq"), "l_orderkey", "l_linenumber")


def from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a score that is a fixed function of the text's size: seq, y, score."""
    got = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return got.select(F.col("doc_id").alias("seq"), F.col("quality").alias("y"), ((F.col("n_chars") % 997) / F.lit(997.0)).alias("score"))


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], identity: tuple[str, dict[str, str], str] | None = None) -> DataFrame:
    """Attempts from CSV with an explicit schema; refuses a file that lacks a column.

    identity (path, columns, id): a second file whose columns are joined on the id; attempts without
    a row there keep nulls.
    """
    head = spark.read.option("header", True).csv(path).columns
    if missing := sorted(set(columns) - set(head)):
        raise NotImplementedError(f"{path} lacks {', '.join(missing)}")
    got = spark.read.option("header", True).schema(", ".join(f"`{c}` {columns.get(c, 'string')}" for c in head)).csv(path).select(*columns)
    return got if identity is None else got.join(read_csv(spark, *identity[:2]), identity[2], "left")
