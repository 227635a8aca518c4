"""Incidents: alerts joined over shared values, their features, risk, and the cheapest action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.features import link_key
from .components import label

# Action, friction, false harm, share stopped, analyst minutes; costs of a miss and a minute.
ACTIONS = (("monitor", 0.0, 0.0, 0.0, 0.0), ("rate_limit", 120.0, 400.0, 0.55, 0.0), ("step_up", 350.0, 1800.0, 0.85, 0.0), ("hold_review", 900.0, 6000.0, 0.97, 12.0), ("review_only", 0.0, 0.0, 0.0, 12.0))
MISS, MINUTE = 73.0, 9.0


def capped_values(df: DataFrame, rel: str, share: float = 0.02) -> DataFrame:
    """Values too common to link over: more than max(share * rows, 1) of the whole stream."""
    n = df.count()
    return df.groupBy(link_key(df, rel).alias("value")).agg(F.count("*").alias("n")).where(F.col("value").isNotNull() & (F.col("n") > max(share * n, 1.0)))


def sessions(df: DataFrame, alert: Column, relations: tuple[str, ...], gap_s: float = 900.0, share: float = 0.02) -> DataFrame:
    """seq, rel, value, session: alerts of one value, parted where the gap exceeds gap_s."""
    n = df.count()
    long = df.withColumn("a_", alert).select("seq", "ts_s", "a_", F.explode(F.array(*[F.struct(F.lit(r).alias("rel"), link_key(df, r).alias("value")) for r in relations])).alias("x")).select("seq", "ts_s", "a_", "x.*").where("value is not null")
    often = long.groupBy("rel", "value").agg(F.count("*").alias("n")).where(F.col("n") > max(share * n, 1.0))
    w = Window.partitionBy("rel", "value").orderBy("ts_s", "seq")
    d = long.where("a_").join(often.select("rel", "value"), ["rel", "value"], "left_anti")
    new = F.coalesce((F.col("ts_s") - F.lag("ts_s").over(w) > gap_s).cast("long"), F.lit(0))
    return d.withColumn("new_", new).withColumn("session", F.sum("new_").over(w)).select("seq", "rel", "value", "session")


def incidents(df: DataFrame, alert: Column, relations: tuple[str, ...], gap_s: float = 900.0, share: float = 0.02) -> DataFrame:
    """Per component of linked alerts: members and their sums; an alert without links is its own."""
    return summarise(members(df, alert, relations, gap_s, share))


def members(df: DataFrame, alert: Column, relations: tuple[str, ...], gap_s: float = 900.0, share: float = 0.02) -> DataFrame:
    """The alerts of df, each with its component."""
    s = sessions(df, alert, relations, gap_s, share)
    comp = label(s.select("seq", F.concat_ws("|", "rel", "value", F.col("session").cast("string")).alias("grp")))
    return df.withColumn("a_", alert).where("a_").drop("a_").join(comp, "seq", "left").withColumn("component", F.coalesce("component", "seq"))


def summarise(a: DataFrame) -> DataFrame:
    g = a.groupBy("component").agg(
        F.count("*").alias("n_attempts"), F.min("ts_s").alias("t_start"), F.max("ts_s").alias("t_end"), F.count_distinct("device_id").alias("n_devices"),
        F.count_distinct("ip_id").alias("n_ips"), F.count_distinct("bin_id").alias("n_bins"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"),
        F.avg(F.col("label").cast("double")).alias("campaign_share"))
    return g.withColumn("is_true", F.col("campaign_share") >= 0.5)


def incident_features(inc: DataFrame) -> DataFrame:
    return inc.select("component", *[F.log1p(F.col(c).cast("double")).alias(f"log_{c}") for c in ("n_attempts", "n_devices", "n_ips", "n_bins")], F.log1p(F.col("t_end") - F.col("t_start")).alias("log_duration"), "mean_score", "max_score", F.lit(1.0).alias("one"))


def fit_risk(x, y, steps: int = 400, rate: float = 0.25, l2: float = 1.0):
    """Logistic fit by gradient descent on standardised features; returns (mean, scale, weights)."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ w)))
        w -= rate * (z.T @ (p - y) / len(y) + l2 * w / len(y))
    return mean, scale, w


def risk(features: tuple[str, ...], mean, scale, w) -> Column:
    z = sum(((F.col(c) - float(m)) / float(s) * float(k) for c, m, s, k in zip(features, mean, scale, w)), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def expected_costs(df: DataFrame, risk: str = "risk", remaining: str = "remaining", actions=ACTIONS) -> DataFrame:
    """Every row against every action (at most five): its expected cost."""
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("action"), F.lit(f).alias("friction"), F.lit(h).alias("harm"), F.lit(s).alias("stops"), F.lit(m).alias("minutes")) for i, (n, f, h, s, m) in enumerate(actions)])
    d = df.withColumn("x", F.explode(rows)).select(*df.columns, "x.*")
    return d.withColumn("cost", F.col("friction") + MINUTE * F.col("minutes") + F.col(risk) * F.col(remaining) * MISS * (1 - F.col("stops")) + (1 - F.col(risk)) * F.col("harm"))


def cheapest(risk: Column, remaining: Column) -> Column:
    """The name of the cheapest of the four autonomous actions, the first declared of equals."""
    cost = lambda f, h, s, m: F.lit(f + MINUTE * m) + risk * remaining * MISS * (1 - s) + (1 - risk) * h
    return F.array_min(F.array(*[F.struct(cost(f, h, s, m).alias("cost"), F.lit(i).alias("ord"), F.lit(n).alias("action")) for i, (n, f, h, s, m) in enumerate(ACTIONS[:4])]))["action"]


def choose(df: DataFrame, key: str, risk: str = "risk", remaining: str = "remaining") -> DataFrame:
    """The cheapest of the four autonomous actions, the first declared of equals."""
    d = expected_costs(df, risk, remaining, ACTIONS[:4])
    return d.groupBy(key).agg(F.min_by("action", F.struct("cost", "ord")).alias("action"), F.min("cost").alias("cost"))


def guarded(action: Column, drifted: Column) -> Column:
    return F.when(drifted & (action != "monitor"), "review_only").otherwise(action)


# How many attempts of an incident a snapshot sees.
SNAPSHOT_SIZES = (3, 5, 8, 12, 20, 32, 50, 80, 128, 200, 320)


def snapshots(a: DataFrame, sizes=SNAPSHOT_SIZES) -> DataFrame:
    """Of each incident's first m alerts, for each size m below its own: sums, and what was still to come."""
    w = Window.partitionBy("component").orderBy("ts_s", "seq")
    d = a.withColumn("rn", F.row_number().over(w)).withColumn("len", F.count("*").over(Window.partitionBy("component")))
    d = d.withColumn("m", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda m: (m < F.col("len")) & (m >= F.col("rn")))))
    return d.groupBy("component", "m").agg((F.max("ts_s") - F.min("ts_s")).alias("span_s"), F.count_distinct("device_id").alias("n_devices"), F.count_distinct("ip_id").alias("n_ips"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), (F.max("len") - F.col("m")).alias("target"))


def snapshot_features(a: DataFrame, sizes=SNAPSHOT_SIZES) -> DataFrame:
    """All features of each incident's first m attempts (component, ts_s, seq, score, approved, entities), for each
    size m below its own, the count still to come, and the time of the last attempt seen."""
    w = Window.partitionBy("component").orderBy("ts_s", "seq")
    d = a.withColumn("rn", F.row_number().over(w)).withColumn("len", F.count("*").over(Window.partitionBy("component")))
    d = d.withColumn("m", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda m: (m < F.col("len")) & (m >= F.col("rn")))))
    half = F.greatest(F.floor(F.col("m") / 2), F.lit(1))
    d = d.withColumn("half", half)
    early, late = F.col("rn") <= F.col("half"), F.col("rn") > F.col("half")
    g = d.groupBy("component", "m").agg(
        F.max("half").cast("double").alias("half"), F.min("ts_s").alias("t0"), F.max("ts_s").alias("t_snapshot"), F.max(F.when(F.col("rn") == F.col("half"), F.col("ts_s"))).alias("th"),
        F.avg("score").alias("mean_score"), F.avg(F.when(late, F.col("score"))).alias("late"), F.avg(F.when(early, F.col("score"))).alias("early"), F.avg((~F.col("approved")).cast("double")).alias("decline_ratio"),
        *[F.count_distinct(c).cast("double").alias(n) for c, n in (("device_id", "n_devices"), ("ip_id", "n_ips"), ("bin_id", "n_bins"))], (F.max("len") - F.col("m")).cast("double").alias("remaining"))
    m, age = F.col("m").cast("double"), F.col("t_snapshot") - F.col("t0")
    pace = lambda span: F.col("half") / F.greatest(span, F.lit(1e-6))
    return g.select("component", "m", m.alias("n_observed"), F.log1p(m).alias("log_n"), age.alias("age_s"), F.log1p(age).alias("log_age"), (m / F.greatest(age, F.lit(1.0))).alias("rate"),
                    (pace(F.col("t_snapshot") - F.col("th")) / F.greatest(pace(F.col("th") - F.col("t0")), F.lit(1e-9))).alias("rate_trend"), "mean_score",
                    F.coalesce(F.col("late") - F.col("early"), F.lit(0.0)).alias("score_trend"), "decline_ratio", "n_devices", "n_ips", "n_bins",
                    (m / F.greatest(F.col("n_devices") + F.col("n_ips") + F.col("n_bins"), F.lit(1.0))).alias("entity_density"), "remaining", "t_snapshot")


def build_snapshots(df: DataFrame, stream: str, alert: Column, relations: tuple[str, ...], gap_s: float = 900.0, share: float = 0.02, sizes=SNAPSHOT_SIZES) -> DataFrame:
    """snapshot_features of a stream's incidents, with incident_id (the stream, then the number), so that several streams' snapshots can be put together."""
    a = members(df, alert, relations, gap_s, share).checkpoint()
    ids = numbered(a.groupBy("component").agg(F.min("ts_s").alias("t_start"))).select("component", F.concat_ws(":", F.lit(stream), "incident_id").alias("incident_id"))
    return snapshot_features(a, sizes).join(ids, "component")


def numbered(inc: DataFrame, slice_s: float = 86_400.0) -> DataFrame:
    """Incidents with incident_id, INC-000 on, by start, then least member; slices of time are numbered apart."""
    d = inc.withColumn("slice_", F.floor(F.col("t_start") / slice_s))
    n = d.groupBy("slice_").agg(F.count("*").alias("n_"))
    first = n.select("slice_", F.coalesce(F.sum("n_").over(Window.orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    rank = F.row_number().over(Window.partitionBy("slice_").orderBy("t_start", "component")) - 1
    return d.join(first, "slice_").withColumn("incident_id", F.format_string("INC-%03d", F.col("base_") + rank)).drop("slice_", "base_")


def lead(inc: DataFrame, risk: str = "risk") -> DataFrame:
    """The incident of highest risk; of equals the larger, then the first."""
    return inc.agg(F.max_by(F.struct(*inc.columns), F.struct(risk, "n_attempts", -F.col("component"))).alias("x")).select("x.*")


def largest_group(groups: DataFrame, df: DataFrame) -> DataFrame:
    """Of (seq, component): the largest component (lowest of equals), its share of campaign rows and what share of all of them it holds."""
    d = df.select("seq", "label").join(groups.select("seq", "component"), "seq", "left")
    total = d.agg(F.sum(F.col("label").cast("double")).alias("all"))
    g = d.where("component is not null").groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("double")).alias("hit"))
    top = g.agg(F.max_by(F.struct("component", "n", "hit"), F.struct("n", -F.col("component"))).alias("x")).select("x.*")
    return top.join(F.broadcast(total)).select("component", "n", (F.col("hit") / F.col("n")).alias("purity"), F.try_divide("hit", "all").alias("recall"))  # one row against one


def dossier() -> Column:
    """A text report of an incident, from columns incident_id, n_attempts, n_devices, n_ips, n_bins, risk, observed,
    p50, p90, action, costs (a map of all actions), oracle."""
    per = lambda c: F.format_number(F.col("n_attempts") / F.greatest(F.col(c), F.lit(1)), 1)
    money = lambda c: F.format_number(c, 0)
    wide = F.when(F.col("p90") > 4 * F.greatest("p50", F.lit(1.0)), " (wide: review)").otherwise("")
    return F.concat_ws("\n",
        F.concat(F.lit("Incident "), "incident_id"),
        F.format_string("Size: %d attempts over %d devices, %d addresses, %d bins", "n_attempts", "n_devices", "n_ips", "n_bins"),
        F.concat(F.lit("Attempts per device "), per("n_devices"), F.lit(", address "), per("n_ips"), F.lit(", bin "), per("n_bins")),
        F.concat(F.lit("Risk: "), F.format_number("risk", 3)),
        F.concat(F.lit("Seen at decision: "), F.col("observed").cast("string")),
        F.concat(F.lit("Still to come: "), F.format_number("p50", 0), F.lit(", up to "), F.format_number("p90", 0), wide),
        F.concat(F.lit("At stake: "), money(F.col("p50") * MISS), F.lit(", up to "), money(F.col("p90") * MISS)),
        F.concat(F.lit("Action: "), "action"),
        F.concat(F.lit("Expected cost: "), money(F.element_at("costs", F.col("action"))), F.lit(" against "), money(F.element_at("costs", F.lit("monitor"))), F.lit(" if watched")),
        F.concat(F.lit("With hindsight: "), "oracle", F.when(F.col("oracle") == F.col("action"), " (the same)").otherwise(" (another)")))


def option_costs(df: DataFrame, key: str, risk: str = "risk", remaining: str = "remaining") -> DataFrame:
    """key, action, cost, costs: the cheapest autonomous action and a map of what each would cost."""
    d = expected_costs(df, risk, remaining, ACTIONS[:4])
    return d.groupBy(key).agg(F.min_by("action", F.struct("cost", "ord")).alias("action"), F.min("cost").alias("cost"), F.map_from_entries(F.collect_list(F.struct("action", "cost"))).alias("costs"))


def unfitted_risk(mean_score: Column) -> Column:
    """Risk where no fit is possible (no incidents, or one class only): the mean score, at most 1."""
    return F.least(mean_score, F.lit(1.0))
