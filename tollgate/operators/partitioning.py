"""What sharding and replication do to links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import ensure_checkpoint
from .links import kept, shared_entity_score
from .metrics import COST_FALSE, COST_MISS, average_precision


def shard(strategy: str, n: int) -> Column:
    if n == 1:
        return F.lit(0)
    if strategy == "random":
        return F.pmod(F.xxhash64("seq"), F.lit(n))
    if strategy in ("bin_id", "device_id", "ip_id"):
        return F.pmod(F.crc32(F.col(strategy).cast("string").cast("binary")), F.lit(n))
    raise ValueError(f"unknown strategy {strategy}")


def edges_preserved(df: DataFrame, shard: Column, relations: tuple[str, ...], window_s: float, cap: int = 32) -> DataFrame:
    """Per relation the share of links whose ends lie in one shard."""
    return edges_surviving(df, F.array(shard), relations, window_s, cap)


def places(df: DataFrame, primary: Column, replicate: dict[str, Column], least: int = 2) -> DataFrame:
    """df with places: the primary shard and that of every value met `least` times or more, each once."""
    got = df.withColumn("p_", primary)
    more = []
    for c, s in replicate.items():
        got = got.withColumn(f"r_{c}", F.when(F.col(c).isNotNull() & (F.count("*").over(Window.partitionBy(c)) >= least), s))
        more.append(f"r_{c}")
    return got.withColumn("places", F.array_distinct(F.array_compact(F.array("p_", *more)))).drop("p_", *more)


def placements(df: DataFrame, primary: Column, replicate: dict[str, Column], least: int = 2) -> DataFrame:
    """seq, shard: a row for each of a row's places."""
    return places(df, primary, replicate, least).select("seq", F.explode("places").alias("shard"))


def edges_surviving(df: DataFrame, placed: Column, relations: tuple[str, ...], window_s: float, cap: int = 32) -> DataFrame:
    """Per relation the share of links whose ends share a shard among all that they are placed in (an array)."""
    got = kept(df, {"": placed}, relations, window_s, cap)
    return got.where("edges > 0").select("rel", "edges", "kept", (F.col("kept") / F.col("edges")).alias("share"))


def score_sharded(df: DataFrame, shards: DataFrame, scorer, out: str = "score") -> DataFrame:
    """scorer(rows, also) run within shards (seq, shard; a row may be placed in several): per row the highest score,
    0 at least, and how many copies it had."""
    got = scorer(df.join(shards.select("seq", "shard"), "seq"), ("shard",))
    return got.groupBy("seq").agg(F.greatest(F.max(out), F.lit(0.0)).alias(out), F.count("*").alias("copies"))


def routed(df: DataFrame, shards: dict[str, Column]) -> DataFrame:
    """seq, routing, shard: every row under each named way to route it."""
    return df.select("seq", F.explode(F.array(*[F.struct(F.lit(n).alias("routing"), c.cast("int").alias("shard")) for n, c in shards.items()])).alias("x")).select("seq", "x.*")


def sweep(df: DataFrame, placed: DataFrame, relations: tuple[str, ...], threshold: float, window_s: float, cap: int = 32, y: str = "label") -> DataFrame:
    """A row a routing: what the shared-entity score of each shard's own links detects, what of the whole stream's links is left, and how even shards are.

    placed has seq, routing, shard, a row for each place (several under replication: the best score
    counts, and a link is left if its ends meet anywhere). All routings go through one link job,
    kept apart by a key, and metrics are groups of it; nothing is run once a routing. Links of the whole
    stream are counted where they are found and never written.
    """
    ensure_checkpoint(df.sparkSession)
    rows = df.join(placed, "seq")
    got = shared_entity_score(rows, relations, window_s, cap, ("routing", "shard")).groupBy("routing", "seq").agg(F.max("shared").alias("score"), F.first(y).alias("y")).checkpoint()  # two readers
    hit = F.col("score") >= threshold
    quality = got.groupBy("routing").agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") != 1)).alias("false_positives"), F.count_if(~hit & (F.col("y") == 1)).alias("missed"), F.count("*").alias("rows"))
    names = sorted(r["routing"] for r in placed.select("routing").distinct().collect())  # a row a routing
    sets = placed.groupBy("seq").agg(*[F.collect_set(F.when(F.col("routing") == n, F.col("shard"))).alias(f"at_{i}") for i, n in enumerate(names)])
    at = df.join(sets, "seq", "left")
    left = kept(at, {n: F.col(f"at_{i}") for i, n in enumerate(names)}, relations, window_s, cap).checkpoint()  # a row a routing and relation; two readers
    whole = left.where(F.col("routing") == names[0]).agg(F.sum("edges").alias("all"), *[F.sum(F.when(F.col("rel") == r, F.col("edges"))).alias(f"all_{r}") for r in relations]) if names else left.agg(*[F.lit(0).alias(c) for c in ("all", *[f"all_{r}" for r in relations])])
    left = left.groupBy("routing").agg(F.sum("kept").alias("left"), *[F.sum(F.when(F.col("rel") == r, F.col("kept"))).alias(f"left_{r}") for r in relations])
    load = placed.groupBy("routing", "shard").agg(F.count("*").alias("n")).groupBy("routing").agg(F.max("n").alias("most"), F.sum("n").alias("places"))
    d = quality.join(average_precision(got, "score", "y", ("routing",)), "routing").join(load, "routing").join(left, "routing", "left").join(F.broadcast(whole))
    share = lambda part, of: F.coalesce(F.col(part), F.lit(0)) / F.greatest(F.coalesce(F.col(of), F.lit(0)), F.lit(1))
    return d.select("routing", F.round("average_precision", 4).alias("pr_auc"), F.round(F.coalesce(F.try_divide("tp", F.col("tp") + F.col("false_positives")), F.lit(0.0)), 4).alias("precision"),
                    F.round(F.coalesce(F.try_divide("tp", F.col("tp") + F.col("missed")), F.lit(0.0)), 4).alias("recall"), "false_positives", "missed", F.round(F.col("missed") * COST_MISS + F.col("false_positives") * COST_FALSE, 1).alias("decision_cost"),
                    F.round(share("left", "all"), 4).alias("edges_kept"), *[F.round(share(f"left_{r}", f"all_{r}"), 4).alias(f"{r[:-3]}_edges_kept") for r in relations],
                    F.round(F.col("most") / F.col("rows"), 4).alias("largest_shard_share"), F.round(F.col("places") / F.col("rows"), 3).alias("duplication"))
