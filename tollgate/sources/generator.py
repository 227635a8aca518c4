"""Synthetic attempts: background traffic, labelled campaigns, tenants, and faults.

Rows come from spark.range and hashes of (seed, row), so a stream is the same however it is
partitioned and grows without a driver-side table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Share of distinct values and skew of each entity; mail domains and their shares.
SHAPES = {"device_id": (0.80, 0.45), "ip_id": (0.25, 0.70), "bin_id": (0.02, 0.90)}
DOMAINS = (("gmail.com", 0.55), ("yahoo.com", 0.15), ("outlook.com", 0.15), ("corp.example", 0.10), ("other.example", 0.05))


@dataclass(frozen=True)
class Campaign:
    name: str
    attempts: int
    entities: int
    start_s: float
    duration_s: float
    camouflage: float = 1.0
    seed: int = 0


def uniform(seed: int, name: str, row: Column | str = "id") -> Column:
    """A number in [0, 1) for each row."""
    row = F.col(row) if isinstance(row, str) else row
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), row), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def _normal(seed: int, name: str) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, name + "/a"))) * F.cos(2 * math.pi * uniform(seed, name + "/b"))


def _skewed(seed: int, name: str, pool: int, alpha: float) -> Column:
    """Rank in 1..pool with a chance near rank^-alpha: the inverse of the continuous sum."""
    u = uniform(seed, name)
    if abs(alpha - 1) < 1e-9:
        x = F.exp(u * math.log(pool + 1))
    else:
        x = F.pow(u * ((pool + 1) ** (1 - alpha) - 1) + 1, F.lit(1 / (1 - alpha)))
    return F.least(F.floor(x), F.lit(pool))


def background(spark: SparkSession, n: int, seed: int = 0, span_s: float = 14_400.0, decline_rate: float = 0.1, shapes=SHAPES) -> DataFrame:
    mail, at = F.lit(DOMAINS[-1][0]), 1.0
    for name, share in reversed(DOMAINS[:-1]):
        at = sum(s for _, s in DOMAINS[:[d for d, _ in DOMAINS].index(name) + 1])
        mail = F.when(uniform(seed, "mail") < at, name).otherwise(mail)
    ids = {c: F.concat(F.lit(f"{c[:3]}_"), _skewed(seed, c, max(int(n * f), 2), a).cast("string")) for c, (f, a) in shapes.items()}
    return spark.range(n).select(
        F.col("id").alias("row"), (uniform(seed, "ts") * span_s).alias("ts_s"), F.round(F.exp(6.2 + 1.1 * _normal(seed, "amount")), 2).alias("amount"),
        F.concat(F.lit("card_"), "id").alias("card_id"), *[x.alias(c) for c, x in ids.items()], mail.alias("email_domain"),
        (uniform(seed, "approved") > decline_rate).alias("approved"), F.lit(0).alias("label"), F.lit(None).cast("string").alias("campaign_id"))


def campaign(spark: SparkSession, c: Campaign, like: DataFrame) -> DataFrame:
    """Attempts dealt evenly over `entities` values of each kind, each kind dealt on its own; every card is new.

    With a chance of camouflage an attempt's amount and mail are those of two drawn rows of like.
    """
    d = spark.range(c.attempts)
    deal = lambda name: F.concat(F.lit(f"{name}_{c.name}_{c.seed}_"), ((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(uniform(c.seed, name))) - 1) % c.entities).cast("string"))  # noqa: E731  a campaign is small
    m = like.count()
    ranks = like.select((F.row_number().over(Window.orderBy("row")) - 1).alias("r"), "amount", "email_domain")
    d = d.select("id", (c.start_s + uniform(c.seed, "ts") * c.duration_s).alias("ts_s"), *[deal(k).alias(k) for k in SHAPES],
                 F.floor(uniform(c.seed, "amount from") * m).alias("ra"), F.floor(uniform(c.seed, "mail from") * m).alias("rm"), (uniform(c.seed, "hidden") < c.camouflage).alias("hidden"),
                 F.round(1 + 19 * uniform(c.seed, "small"), 2).alias("own_amount"), F.when(uniform(c.seed, "mail") < 0.5, "gmail.com").otherwise("outlook.com").alias("own_mail"), (uniform(c.seed, "approved") < 0.04).alias("approved"))
    d = d.join(ranks.select(F.col("r").alias("ra"), "amount"), "ra", "left").join(ranks.select(F.col("r").alias("rm"), "email_domain"), "rm", "left")
    return d.select(F.col("id").alias("row"), "ts_s", F.when(F.col("hidden"), F.col("amount")).otherwise(F.col("own_amount")).alias("amount"), F.concat(F.lit(f"card_{c.name}_"), "id").alias("card_id"),
                    *SHAPES, F.when(F.col("hidden"), F.col("email_domain")).otherwise(F.col("own_mail")).alias("email_domain"), "approved", F.lit(1).alias("label"), F.lit(c.name).alias("campaign_id"))


def inject(base: DataFrame, campaigns: list[Campaign]) -> DataFrame:
    """Background and campaigns in time order; seq numbers rows, the background first among equal times."""
    parts = [base.withColumn("part", F.lit(0))] + [campaign(base.sparkSession, c, base).withColumn("part", F.lit(i + 1)) for i, c in enumerate(campaigns)]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    # Numbers by slices of time with the slices' totals added: no task orders the whole stream.
    d = d.withColumn("slice_", F.floor(F.col("ts_s") / 600))
    n = d.groupBy("slice_").agg(F.count("*").alias("n_"))
    first = n.withColumn("base_", F.sum("n_").over(Window.orderBy("slice_")) - F.col("n_")).drop("n_")
    rank = F.row_number().over(Window.partitionBy("slice_").orderBy("ts_s", "part", "row"))
    return d.withColumn("rank_", rank).join(first, "slice_").withColumn("seq", F.col("base_") + F.col("rank_") - 1).drop("slice_", "rank_", "base_", "part", "row")


def tenants(spark: SparkSession, n_tenants: int, rows: int, c: Campaign, seed: int = 0) -> DataFrame:
    """A background per tenant, with ids of its own, and one campaign dealt over all of them."""
    d = None
    for t in range(n_tenants):
        b = background(spark, rows, seed + 1000 * t).withColumn("merchant_id", F.lit(f"m{t}"))
        for k in (*SHAPES, "card_id"):
            b = b.withColumn(k, F.concat_ws("_", "merchant_id", k))
        b = b.withColumn("row", F.col("row") + t * rows)
        d = b if d is None else d.unionByName(b)
    got = campaign(spark, c, d).withColumn("merchant_id", F.concat(F.lit("m"), F.floor(uniform(c.seed, "tenant", "row") * n_tenants)))
    return d.unionByName(got.withColumn("row", F.col("row") + n_tenants * rows))


FAULTS = ("clean", "null_device", "placeholder_device", "nan_amount", "dropped_approved", "entity_explosion")


def corrupt(df: DataFrame, kind: str, rate: float, seed: int = 0) -> DataFrame:
    """Each row is hit with a chance of rate, by a hash of its seq."""
    if kind not in FAULTS:
        raise ValueError(f"unknown fault {kind}")
    hit = uniform(seed, kind, "seq") < rate
    put = lambda c, bad: df.withColumn(c, F.when(hit, bad).otherwise(F.col(c)))
    if kind == "clean":
        return df
    if kind == "null_device":
        return put("device_id", F.lit(None).cast("string"))
    if kind == "placeholder_device":
        return put("device_id", F.lit("unknown_device"))
    if kind == "nan_amount":
        return put("amount", F.lit(float("nan")))
    if kind == "dropped_approved":
        return put("approved", F.lit(None).cast("boolean"))
    for c in ("device_id", "ip_id", "bin_id"):
        df = df.withColumn(c, F.when(hit, F.concat(F.col(c), F.lit("_"), F.col("seq").cast("string"))).otherwise(F.col(c)))
    return df
