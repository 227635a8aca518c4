"""Evaluation metrics over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import ensure_checkpoint

COST_MISS, COST_FALSE = 73.0, 40.0


def alert(score: Column, threshold: float) -> Column:
    """score >= threshold; a NaN or null score never alerts."""
    return F.coalesce(~F.isnan(score) & (score >= threshold), F.lit(False))


#: Distinct values that one task takes running totals over.
RANGE_ROWS = 100_000


def running(g: DataFrame, by: str, sums: tuple[str, ...], keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """g, whose values of `by` are distinct (within keys), with upto_ and total_ of each summed column.

    g is computed once. Up to RANGE_ROWS values, one window a key does. Beyond, values are dealt to
    ranges between approximate percentiles, as many as the values call for (or `parts`); totals of the ranges
    run in a window of a row a range, the values within a range in one of its own.
    """
    ensure_checkpoint(g.sparkSession)
    g = g.checkpoint()
    parts = -(-g.count() // RANGE_ROWS) if parts is None else parts
    if parts < 2:
        w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        upto = w.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return g.select("*", *[F.sum(c).over(w).alias(f"total_{c}") for c in sums], *[F.sum(c).over(upto).alias(f"upto_{c}") for c in sums])
    marks = [i / parts for i in range(1, parts)]
    cuts = g.groupBy(*keys).agg(F.percentile_approx(by, marks, max(10_000, 8 * parts)).alias("cuts_"))
    cuts = g.join(cuts, list(keys)) if keys else g.join(F.broadcast(cuts))  # without keys one row
    d = cuts.withColumn("part_", F.size(F.filter(F.coalesce("cuts_", F.array()), lambda c: F.col(by) >= c))).drop("cuts_")
    ranges = d.groupBy(*keys, "part_").agg(*[F.sum(c).alias(f"sum_{c}") for c in sums])
    w = Window.partitionBy(*keys)
    before = w.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "part_", *[F.coalesce(F.sum(f"sum_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in sums], *[F.sum(f"sum_{c}").over(w).alias(f"total_{c}") for c in sums])
    d = d.join(ranges, [*keys, "part_"])
    here = Window.partitionBy(*keys, "part_").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.select("*", *[(F.col(f"before_{c}") + F.sum(c).over(here)).alias(f"upto_{c}") for c in sums]).drop("part_", *[f"before_{c}" for c in sums])


def scored(df: DataFrame, score: str) -> DataFrame:
    """Rows with a score that can be ranked: null and NaN scores are left out."""
    return df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def average_precision(df: DataFrame, score: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Step-wise, within keys: over distinct scores from the top, recall gained times precision. Null without positives. Rows without a score are left out."""
    g = scored(df, score).groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.count("*").alias("n"))
    g = running(g, "s", ("p", "n"), keys).withColumn("tp", F.col("total_p") - F.col("upto_p") + F.col("p")).withColumn("all", F.col("total_n") - F.col("upto_n") + F.col("n"))
    return g.groupBy(*keys).agg(F.sum(F.when(F.col("total_p") > 0, F.col("p") / F.col("total_p") * F.col("tp") / F.col("all"))).alias("average_precision"))


def bin_of(score: Column, bins: int) -> Column:
    """The bin of equal-width edges i / bins as doubles: edges belong to the bin above, ends are clipped."""
    import numpy as np

    inner = [float(x) for x in np.linspace(0, 1, bins + 1)[1:-1]]
    return sum((F.when(score >= e, 1).otherwise(0) for e in inner), F.lit(0))


def reliability(df: DataFrame, score: str, y: str, bins: int = 10) -> DataFrame:
    """Per bin the mean score, mean label and count; empty bins are kept with nulls."""
    got = df.groupBy(bin_of(F.col(score), bins).alias("bin")).agg(F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("mean_label"), F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(rel: DataFrame) -> DataFrame:
    r = rel.where("n > 0")
    return r.agg((F.sum(F.abs(F.col("mean_score") - F.col("mean_label")) * F.col("n")) / F.sum("n")).alias("ece"))


def threshold_costs(df: DataFrame, score: str, y: str, c_miss: float = COST_MISS, c_false: float = COST_FALSE) -> DataFrame:
    """Cost of every candidate threshold (distinct scores to 4 places, half to even), applied to unrounded scores."""
    s = scored(df, score).select(F.col(score).alias("at"), F.col(y).cast("long").alias("y"))
    marks = s.select(F.bround("at", 4).alias("at")).distinct().select("at", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("cand"))
    axis = s.groupBy("at").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"), F.lit(False).alias("cand")).unionByName(marks)
    axis = running(axis.groupBy("at").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.max("cand").alias("cand")), "at", ("p", "n")).where("cand")
    return axis.withColumn("missed", F.col("upto_p") - F.col("p")).withColumn("false_alarms", F.col("total_n") - F.col("upto_n") + F.col("n")).select(
        F.col("at").alias("threshold"), "missed", "false_alarms", (F.col("missed") * c_miss + F.col("false_alarms") * c_false).alias("cost"))


def best_threshold(costs: DataFrame) -> DataFrame:
    """The least cost; the lowest threshold of equals. With one candidate or none: abstain, above it."""
    return costs.agg(F.count("*").alias("n"), F.min(F.struct("cost", "threshold")).alias("b"), F.max("threshold").alias("m")).select(
        F.when(F.col("n") > 1, F.col("b.threshold")).otherwise(F.coalesce(F.col("m"), F.lit(0.0)) + 1).alias("threshold"), F.when(F.col("n") > 1, F.col("b.cost")).alias("cost"))


def confusion(df: DataFrame, hit: Column, y: Column) -> DataFrame:
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    g = df.agg(one(hit & y).alias("tp"), one(hit & ~y).alias("fp"), one(~hit & y).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return g.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn(
        "decision_cost", F.col("fn") * COST_MISS + F.col("fp") * COST_FALSE)


def detection(df: DataFrame, hit: Column) -> DataFrame:
    """Per campaign: attempts, seconds to the first alert (null if none), money at stake and saved."""
    w = Window.partitionBy("campaign_id")
    d = df.where("campaign_id is not null").withColumn("hit_", hit).withColumn("first_", F.min(F.when(F.col("hit_"), F.col("ts_s"))).over(w))
    return d.groupBy("campaign_id").agg(F.count("*").alias("attempts"), (F.min("first_") - F.min("ts_s")).alias("detect_s"), (F.count("*") * COST_MISS).alias("exposure"),
                                        (F.coalesce(F.sum(F.when(F.col("ts_s") > F.col("first_"), 1)), F.lit(0)) * COST_MISS).alias("prevented"))


def latency_curve(df: DataFrame, hit: Column, campaign: str, checkpoints: tuple[float, ...]) -> DataFrame:
    """Precision and recall over the rows seen by onset + t; precision is null if nothing fired."""
    d = df.withColumn("hit_", hit).withColumn("y_", F.col("label") == 1)
    onset = d.where(F.col("campaign_id") == campaign).agg(F.min("ts_s").alias("onset"))
    d = d.select("ts_s", "hit_", "y_").join(F.broadcast(onset))  # one row
    one = lambda c, t: F.coalesce(F.sum(F.when(c & (F.col("ts_s") <= F.col("onset") + t), 1)), F.lit(0)).cast("long")
    parts = [F.struct(F.lit(float(t)).alias("t_seconds"), one(F.col("hit_") & F.col("y_"), t).alias("tp"), one(F.col("hit_") & ~F.col("y_"), t).alias("fp"), one(~F.col("hit_") & F.col("y_"), t).alias("fn")) for t in checkpoints]
    got = d.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return got.select("t_seconds", "tp", "fp", "fn", F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")).alias("precision"),
                      F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")).alias("recall"))


def exact_quantiles(df: DataFrame, keys: tuple[str, ...], value: str, qs: tuple[float, ...]) -> DataFrame:
    """keys and q: an array of exact, linearly interpolated quantiles. Nulls are left out, a key of nulls only has nulls.

    Ranks come from running counts over ranges of values, so no task holds all values of a key.
    """
    g = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("x_")).agg(F.count("*").alias("m_"))
    got = counted_quantiles(g, keys, qs)
    return df.select(*keys).distinct().join(got, list(keys), "left") if keys else got


def counted_quantiles(g: DataFrame, keys: tuple[str, ...], qs: tuple[float, ...]) -> DataFrame:
    """As exact_quantiles, of values x_ that come with their counts m_."""
    r = running(g, "x_", ("m_",), keys)
    at = [(F.col("total_m_") - 1) * F.lit(q) for q in qs]
    holds = lambda rank: (F.col("upto_m_") > rank) & (F.col("upto_m_") - F.col("m_") <= rank)
    ends = r.groupBy(*keys).agg(*[F.max(F.when(holds(end(p)), F.col("x_"))).alias(f"{name}{i}") for i, p in enumerate(at) for name, end in (("low", F.floor), ("high", F.ceil))], F.max("total_m_").alias("total_m_"))
    between = lambda i, p: F.when(F.floor(p) == F.ceil(p), F.col(f"low{i}")).otherwise((F.ceil(p) - p) * F.col(f"low{i}") + (p - F.floor(p)) * F.col(f"high{i}"))
    return ends.select(*keys, F.array(*[between(i, p) for i, p in enumerate(at)]).alias("q"))


def quantiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact, linearly interpolated median and 2.5 and 97.5 percentiles; nulls are left out."""
    got = exact_quantiles(df, tuple(keys), value, (0.5, 0.025, 0.975))
    return got.select(*keys, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("median", "low", "high"))])


def latency_percentiles(df: DataFrame, ms: str) -> DataFrame:
    """p50, p95, p99 and mean of times in ms, and rows a second at one after another; exact, from running counts."""
    g = df.where(F.col(ms).isNotNull()).groupBy(F.col(ms).cast("double").alias("x_")).agg(F.count("*").alias("m_"))
    at = counted_quantiles(g, (), (0.5, 0.95, 0.99)).select(*[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])
    return at.join(F.broadcast(df.agg(F.avg(ms).alias("mean"), (F.count(ms) * 1000 / F.sum(ms)).alias("per_s"))))  # one row against one


def against_baseline(runs: DataFrame, baseline: DataFrame, on: str = "seed", fp: str = "fp") -> DataFrame:
    """runs with ratio: the baseline's false positives on the same seed over their own; null where there are none."""
    ref = baseline.select(on, F.col(fp).alias("ref_"))
    return runs.join(ref, on, "left").withColumn("ratio", F.when(F.col(fp) > 0, F.col("ref_") / F.col(fp))).drop("ref_")


def cost_loss(df: DataFrame, score: str, y: str) -> DataFrame:
    """Mean expected cost of misses and false alarms."""
    p, l = F.col(score), F.col(y)
    return df.agg(F.avg((1 - p) * l * COST_MISS + p * (1 - l) * COST_FALSE).alias("loss"))
