"""Five policies over incidents with known outcomes: what each would have cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .incidents import ACTIONS, MINUTE, MISS, cheapest

#: Minutes of triage per alert for the policy that treats events one by one.
TRIAGE_MIN = 0.5


def realised(action: Column, is_true: Column, remaining: Column) -> Column:
    """The bill of an action: friction and minutes always; what still came through if real, the harm if not."""
    out = F.lit(None).cast("double")
    for name, friction, harm, stops, minutes in ACTIONS:
        bill = friction + MINUTE * minutes + F.when(is_true, remaining * MISS * (1 - stops)).otherwise(F.lit(harm))
        out = F.when(action == name, bill).otherwise(out)
    return out


# Attempts that a forecast spread over (times the middle one) counts as unsure, and the risk that then asks for review.
UNSURE_RATIO, REVIEW_RISK = 4.0, 0.5
POLICIES = ("always_allow", "always_hold", "event_thresholding", "causal_policy", "oracle_policy")


def decide(inc: DataFrame) -> DataFrame:
    """inc (risk, p50, p90, is_true, remaining) with true_remaining, action, oracle_action and unsure.

    Both choose the cheapest action at the incident's risk. The oracle knows how many attempts are
    still to come, none of a false incident; the causal choice takes the forecast's p50, rounded half
    to even, and sends an unsure, risky incident to review where it would have done nothing.
    """
    d = inc.withColumn("true_remaining", F.when(F.col("is_true"), F.col("remaining")).otherwise(F.lit(0.0)))
    d = d.withColumn("unsure", F.col("p90") > UNSURE_RATIO * F.greatest("p50", F.lit(1.0)))
    d = d.withColumn("oracle_action", cheapest(F.col("risk"), F.col("true_remaining"))).withColumn("action", cheapest(F.col("risk"), F.bround("p50", 0)))
    return d.withColumn("action", F.when(F.col("unsure") & (F.col("risk") > REVIEW_RISK) & (F.col("action") == "monitor"), "hold_review").otherwise(F.col("action")))


def evaluate(inc: DataFrame) -> DataFrame:
    """A row a policy: what each would have cost over incidents with n_attempts (their alerts), risk, p50, p90, is_true, remaining.

    Event thresholding acts as the causal policy does, but every alert is a ticket: its minutes are
    half of one for each alert, and their cost comes on top. Regret is against the oracle's cost.
    """
    d = decide(inc)
    action = {"always_allow": F.lit("monitor"), "always_hold": F.lit("hold_review"), "event_thresholding": F.col("action"), "causal_policy": F.col("action"), "oracle_policy": F.col("oracle_action")}
    per = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("policy"), action[p].alias("does")) for i, p in enumerate(POLICIES)])
    long = d.select("is_true", "true_remaining", "n_attempts", "oracle_action", F.explode(per).alias("x")).select("*", "x.*").drop("x")
    of = lambda k: F.coalesce(*[F.when(F.col("does") == a[0], F.lit(a[k])) for a in ACTIONS])
    acted = F.col("does") != "monitor"
    g = long.groupBy("ord", "policy").agg(
        F.count_if(acted).alias("incidents_actioned"), F.count_if(acted & ~F.col("is_true")).alias("false_incidents"),
        F.sum(F.when(F.col("is_true"), F.col("true_remaining") * of(3)).otherwise(0.0)).alias("stopped"), F.sum(of(4)).alias("minutes"), F.sum("n_attempts").alias("events_alerted"),
        F.sum(realised(F.col("does"), F.col("is_true"), F.col("true_remaining"))).alias("cost"), F.count_if(F.col("does") == F.col("oracle_action")).alias("actions_matching_oracle"), F.count("*").alias("incidents_formed"))
    tickets = F.col("events_alerted") * TRIAGE_MIN
    g = g.withColumn("minutes", F.when(F.col("policy") == "event_thresholding", tickets).otherwise(F.col("minutes")))
    g = g.withColumn("cost", F.round(F.col("cost") + F.when(F.col("policy") == "event_thresholding", tickets * MINUTE).otherwise(0.0), 2))
    oracle = F.max(F.when(F.col("policy") == "oracle_policy", F.col("cost"))).over(Window.partitionBy(F.lit(0)))  # five rows
    return g.select("policy", "incidents_actioned", "false_incidents", F.bround("stopped", 0).cast("long").alias("campaign_attempts_stopped"), F.round("minutes", 1).alias("analyst_minutes"),
                    F.col("cost").alias("merchant_cost"), F.round(F.col("cost") - oracle, 2).alias("regret_vs_oracle"), "actions_matching_oracle", "events_alerted", "incidents_formed")


def remaining_after(df: DataFrame, moments: DataFrame) -> DataFrame:
    """campaign_id, t, remaining: attempts of the campaign later than each moment (campaign_id, t).

    Attempts are counted by time first; then moments and times of a campaign run by in one order.
    """
    n = df.where("campaign_id is not null").groupBy("campaign_id", F.col("ts_s").alias("at")).agg(F.count("*").alias("n"))
    m = moments.select("campaign_id", F.col("t").alias("at")).distinct().withColumn("n", F.lit(None).cast("long"))
    d = n.unionByName(m).withColumn("asked", F.col("n").isNull())
    later = F.sum("n").over(Window.partitionBy("campaign_id").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    here = F.sum("n").over(Window.partitionBy("campaign_id", "at"))
    d = d.withColumn("remaining", F.coalesce(later, F.lit(0)) - F.coalesce(here, F.lit(0)))
    return d.where("asked").select("campaign_id", F.col("at").alias("t"), "remaining")


def incident_reliability(inc: DataFrame, bins: int = 5) -> DataFrame:
    """Per bin of incident risk the mean risk and the share of real incidents; empty bins are kept with nulls."""
    from .metrics import reliability

    got = reliability(inc.withColumn("y_", F.col("is_true").cast("int")), "risk", "y_", bins)
    return got.select(((F.col("bin") + 0.5) / bins).alias("bin_mid"), F.col("mean_score").alias("predicted"), F.col("mean_label").alias("observed"), "n")
