"""Experiments by name: python -m tollgate.plans.experiments NAME OUT. An unknown name exits with 2.

Each builds its streams with sources.generator, scores them, and returns a small frame that
is written as CSV.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import features
from ..operators import boosting, drift, graphnet, incidents, links, metrics, partitioning, policies, windows
from ..operators.components import ensure_checkpoint
from ..sources import generator as g
from ..sources.attempts import MODEL_RELATIONS, RELATIONS
from ..sources.sinks import write_csv

WINDOW_S, ROWS, ATTEMPTS = 3600.0, 6000, 400
# Campaign sizes that streams cycle over, numbers of shards, trials.
SIZES = (150, 240, 380, 520, 700, 900, 300, 460)
SHARDS = (1, 2, 4, 8, 16)
TRIALS, EPOCHS, WIDTH, DEPTH = 10, 60, 32, 3
NODE = ("f_log_amount", "f_small", "f_approved", "f_hour", "f_free_mail", "f_one")


def campaign_stream(spark: SparkSession, seed: int = 0, entities: int = 60, camouflage: float = 1.0, attempts: int | None = None) -> DataFrame:
    return g.inject(g.background(spark, ROWS, 10 * seed + 1), [g.Campaign(f"c{seed}", attempts or ATTEMPTS, entities, 3600.0, 3600.0, camouflage, 10 * seed + 1)])


def _net(train: DataFrame, cols=NODE, relations=MODEL_RELATIONS, **how) -> graphnet.Net:
    how = {"width": WIDTH, "depth": DEPTH, "epochs": EPOCHS} | how
    return graphnet.fit(train.join(features.node_features(train), "seq"), cols, relations, WINDOW_S, **how)


def _scored(d: DataFrame, net: graphnet.Net, cols=NODE) -> DataFrame:
    return graphnet.score(d.join(features.node_features(d), "seq"), net, cols)


def sized_stream(spark: SparkSession, i: int) -> DataFrame:
    """Streams whose campaigns cycle over SIZES."""
    return campaign_stream(spark, i, attempts=min(SIZES[i % len(SIZES)], 2 * ATTEMPTS))


def _detectors(d: DataFrame) -> dict[str, DataFrame]:
    t = d.drop("score") if "score" in d.columns else d
    train = campaign_stream(d.sparkSession, 97, 30)
    net = _net(train)
    gbdt = boosting.fit(train.select("seq", "label").join(features.transaction_features(train), "seq"))
    return {
        "relational": graphnet.score(t.join(features.node_features(t), "seq"), net, NODE).select("seq", "label", "score"),
        "gbdt": boosting.score(t.select("seq", "label").join(features.transaction_features(t), "seq"), gbdt).select("seq", "label", "score"),
        "velocity": windows.multi_velocity(d, {r: 2 for r in MODEL_RELATIONS}, WINDOW_S).select("seq", "label", F.col("velocity").cast("double").alias("score")),
        "decline_burst": windows.trailing_rate(d, ~F.col("approved"), 600.0).select("seq", "label", F.col("rate").alias("score")),
        "shared_entity": links.shared_entity_score(d, RELATIONS, WINDOW_S).select("seq", "label", F.col("shared").alias("score")),
    }


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ablation(spark: SparkSession, seed: int = 0) -> DataFrame:
    d = campaign_stream(spark, seed)
    return _union([metrics.average_precision(s, "score", "label").select(F.lit(k).alias("detector"), F.lit(seed).alias("seed"), "average_precision") for k, s in _detectors(d).items()])


def seeds(spark: SparkSession) -> DataFrame:
    return metrics.quantiles(_union([ablation(spark, s) for s in range(TRIALS)]), ["detector"], "average_precision")


def relations(spark: SparkSession) -> DataFrame:
    d, out = campaign_stream(spark), []
    for skip in (None, *RELATIONS):
        s = links.shared_entity_score(d, tuple(r for r in RELATIONS if r != skip), WINDOW_S)
        out.append(metrics.average_precision(s, "shared", "label").select(F.lit(skip or "none").alias("without"), "average_precision"))
    return _union(out)


def sharding(spark: SparkSession) -> DataFrame:
    """All strategies and numbers of shards in one sweep."""
    ensure_checkpoint(spark)
    d = campaign_stream(spark).checkpoint()
    placed = partitioning.routed(d, {f"{how}/{n}": partitioning.shard(how, n) for n in SHARDS for how in ("random", "bin_id", "device_id")})
    return partitioning.sweep(d, placed, MODEL_RELATIONS, 20.0, WINDOW_S)


def replicate(spark: SparkSession) -> DataFrame:
    """Routing by BIN, without and with replication of shared devices and addresses."""
    ensure_checkpoint(spark)
    d = campaign_stream(spark).checkpoint()
    placed = partitioning.routed(d, {"bin_id": partitioning.shard("bin_id", 8)})
    for least in (2, 4):
        p = partitioning.placements(d, partitioning.shard("bin_id", 8), {c: partitioning.shard(c, 8) for c in ("device_id", "ip_id")}, least)
        placed = placed.unionByName(p.select("seq", F.lit(f"bin_id, copies from {least} on").alias("routing"), F.col("shard").cast("int").alias("shard")))
    return partitioning.sweep(d, placed, MODEL_RELATIONS, 20.0, WINDOW_S)


def aperture(spark: SparkSession) -> DataFrame:
    out = []
    for m in (1, 4):
        d = g.tenants(spark, m, 3000, g.Campaign("c", ATTEMPTS, 60, 3600.0, 3600.0))
        d = d.withColumn("seq", F.col("row"))
        for name, keys in (("gateway", ["device_id"]), ("merchant", ["merchant_id", "device_id"])):
            s = d.select("label", windows.trailing_count(keys, WINDOW_S).cast("double").alias("score"))
            out.append(metrics.average_precision(s, "score", "label").select(F.lit(name).alias("aperture"), F.lit(m).alias("tenants"), "average_precision"))
    return _union(out)


def resilience(spark: SparkSession) -> DataFrame:
    from ..functions.features import reasons

    d, out = campaign_stream(spark), []
    for kind, rate in (("clean", 0.0), ("null_device", 0.1), ("placeholder_device", 0.1), ("nan_amount", 0.05), ("dropped_approved", 0.05), ("entity_explosion", 1.0)):
        c = g.corrupt(d, kind, rate).withColumnRenamed("label", "y")
        out.append(c.agg(F.count_if(F.size(reasons(c)) > 0).alias("quarantined"), F.count("*").alias("n")).select(F.lit(kind).alias("fault"), F.lit(rate).alias("rate"), "quarantined", "n"))
    return _union(out)


def drifts(spark: SparkSession) -> DataFrame:
    base = drift.signature(campaign_stream(spark, 0))
    return _union([drift.psi(base, drift.signature(campaign_stream(spark, s))).select(F.lit(s).alias("seed"), "feature", "psi") for s in (1, 2)])


def bin_concentration(spark: SparkSession) -> DataFrame:
    n = g.background(spark, ROWS, 1).groupBy("bin_id").agg(F.count("*").alias("n"))
    return n.agg((F.max("n") / F.sum("n")).alias("top_share"))


def _ap(scored: DataFrame, score: str = "score", **what) -> DataFrame:
    return metrics.average_precision(scored, score, "label").select(*[F.lit(v).alias(k) for k, v in what.items()], "average_precision")


def mechanism(spark: SparkSession) -> DataFrame:
    """The network with features, links or both taken away."""
    train, d, out = campaign_stream(spark, 97, 30), campaign_stream(spark), []
    for name, cols, depth in (("both", NODE, DEPTH), ("links only", ("f_one",), DEPTH), ("features only", NODE, 0)):
        out.append(_ap(_scored(d, _net(train, cols, depth=depth, **({"width": len(cols)} if depth == 0 else {})), cols), kept=name))
    return _union(out)


def architecture(spark: SparkSession) -> DataFrame:
    """Learned against even mixing, and depths."""
    train, d, out = campaign_stream(spark, 97, 30), campaign_stream(spark), []
    for depth in (1, DEPTH):
        net = _net(train, depth=depth)
        out.append(_ap(_scored(d, net), mixing="learned", depth=depth))
        for l in net.layers:
            l["mix"] = [1 / len(net.relations)] * len(net.relations)
        out.append(_ap(_scored(d, net), mixing="even", depth=depth))
    return _union(out)


def _chosen(spark: SparkSession, grid: list[dict]) -> DataFrame:
    """Each setting on the calibration stream alone, the least expected cost marked."""
    train, calib, out = campaign_stream(spark, 97, 30), campaign_stream(spark, 98, 30), []
    for how in grid:
        s = _scored(calib, _net(train, **how))
        ap = metrics.average_precision(s, "score", "label")
        cost = metrics.best_threshold(metrics.threshold_costs(s, "score", "label"))
        out.append(ap.join(cost).select(F.lit(str(how)).alias("setting"), "average_precision", "threshold", "cost"))  # one row each
    got = _union(out).checkpoint()
    best = got.agg(F.min_by("setting", F.struct("cost", "setting")).alias("b")).first()["b"]  # one name
    return got.withColumn("chosen", F.col("setting") == best)


def select(spark: SparkSession) -> DataFrame:
    return _chosen(spark, [{"rate": r, "depth": k} for r in (0.003, 0.01) for k in (1, DEPTH)])


def capacity(spark: SparkSession) -> DataFrame:
    return _chosen(spark, [{"width": w} for w in (4, 16, WIDTH)])


def ceiling(spark: SparkSession) -> DataFrame:
    """Average precision by width on held-out campaigns of falling density."""
    train, out = campaign_stream(spark, 97, 30), []
    for w in (4, WIDTH):
        net = _net(train, width=w)
        out += [_ap(_scored(campaign_stream(spark, 1, k), net), width=w, entities=k) for k in (30, 120)]
    return _union(out)


def feature_parity(spark: SparkSession) -> DataFrame:
    """The trees with the network's two free-mail domains and with all three."""
    train, d, out = campaign_stream(spark, 97, 30), campaign_stream(spark), []
    for n in (2, 3):
        of = lambda x: x.select("seq", "label").join(features.transaction_features(x, features.FREE_MAIL[:n]), "seq")  # noqa: B023, E731
        out.append(_ap(boosting.score(of(d), boosting.fit(of(train))), domains=n))
    return _union(out)


def _alerts(d: DataFrame) -> DataFrame:
    """The stream with the shared-entity score, and a threshold that one row in a hundred of the background passes."""
    s = links.shared_entity_score(d, RELATIONS, WINDOW_S).withColumnRenamed("shared", "score").checkpoint()
    t = s.where("label = 0").agg(F.percentile("score", F.lit(0.99))).first()[0]  # one number
    return s.withColumn("alert", F.col("score") > t)


def incident_study(spark: SparkSession) -> DataFrame:
    """Every incident of a stream: its risk as fitted on another, the cheapest action, the numbers behind it."""
    known = incidents.incidents(_alerts(campaign_stream(spark, 98, 30)), F.col("alert"), RELATIONS)
    cols = [c for c in incidents.incident_features(known).columns if c != "component"]
    rows = incidents.incident_features(known).join(known.select("component", "is_true"), "component").limit(100_000).collect()  # the fit's bound
    inc = incidents.incidents(_alerts(campaign_stream(spark)), F.col("alert"), RELATIONS).checkpoint()
    if len({r["is_true"] for r in rows}) < 2:
        risk = incidents.unfitted_risk(F.col("mean_score"))
        scored = inc.withColumn("risk", risk)
    else:
        fitted = incidents.fit_risk([[r[c] for c in cols] for r in rows], [float(r["is_true"]) for r in rows])
        scored = inc.join(incidents.incident_features(inc).select("component", incidents.risk(tuple(cols), *fitted).alias("risk")), "component")
    scored = scored.withColumn("remaining", F.col("n_attempts").cast("double"))
    got = incidents.numbered(scored).join(incidents.option_costs(scored, "component").select("component", "action", "cost"), "component")
    return got.select("incident_id", "n_attempts", "n_devices", "risk", "action", "cost", "is_true")


def policy_study(spark: SparkSession) -> DataFrame:
    inc = incident_study(spark).withColumn("component", F.monotonically_increasing_id()).withColumn("remaining", F.col("n_attempts").cast("double"))
    return policies.evaluate(inc.withColumn("p50", F.col("remaining")).withColumn("p90", 2 * F.col("remaining")))


def online(spark: SparkSession) -> DataFrame:
    """Incidents of a replayed stream, four files by arrival, against those of the whole table."""
    from ..operators.components import ensure_checkpoint
    from ..streaming import incidents as streaming_incidents
    import uuid

    ensure_checkpoint(spark)
    d = _alerts(campaign_stream(spark)).withColumn("score", F.col("alert").cast("double")).checkpoint()
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/online-{uuid.uuid4().hex}"
    d.repartitionByRange(4, "seq").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    log = streaming_incidents.run(stream, f"{folder}/log", f"{folder}/offsets", RELATIONS, 1.0)
    whole = incidents.incidents(d, F.col("alert"), RELATIONS)
    return whole.agg(F.count("*").alias("batch_incidents")).select("batch_incidents", *[F.lit(v).alias(f"online_{k}") for k, v in log.stats(spark).items()])


def frontier(spark: SparkSession) -> DataFrame:
    """Over attempts and entities: does velocity see the campaign, and do links; entities on the boundary are attempts / tau."""
    out = []
    for n in (ATTEMPTS // 2, ATTEMPTS):
        for k in (4, 16, 64):
            d = campaign_stream(spark, 1, k, attempts=n)
            v = _ap(windows.multi_velocity(d, {r: 8 for r in MODEL_RELATIONS}, WINDOW_S), "velocity", attempts=n, entities=k, detector="velocity")
            l = _ap(links.shared_entity_score(d, RELATIONS, WINDOW_S), "shared", attempts=n, entities=k, detector="shared_entity")
            out += [x.withColumn("boundary", F.lit(n / 8)) for x in (v, l)]
    return _union(out)


def saturation(spark: SparkSession) -> DataFrame:
    """Links, isolation and values shared between classes as the background grows."""
    out = []
    for m in (1, 2):
        d = g.inject(g.background(spark, m * ROWS, 1), [g.Campaign("c", ATTEMPTS, 60, 3600.0, 3600.0)])
        deg = links.degrees(d, links.edges(d, MODEL_RELATIONS, WINDOW_S))
        out.append(deg.agg(F.avg("degree").alias("degree"), F.avg((F.col("degree") == 0).cast("double")).alias("isolated")).select(F.lit(m * ROWS).alias("rows"), "degree", "isolated"))
    return _union(out)


def latency(spark: SparkSession) -> DataFrame:
    return metrics.latency_curve(_alerts(campaign_stream(spark)), F.col("alert"), "c0", (60.0, 300.0, 900.0, 1800.0, 3600.0))


def replay(spark: SparkSession) -> DataFrame:
    """The rows around the first alert, every campaign row and a thin band of the rest."""
    from ..sources.sinks import replay_subset

    d = _alerts(campaign_stream(spark))
    first = d.where("alert").agg(F.min("ts_s")).first()[0] or 0.0  # one number
    return replay_subset(d, first, -300.0, 900.0, (-3600.0, 7200.0)).select("seq", "ts_s", "score", "label")


def benchmark(spark: SparkSession) -> DataFrame:
    """Milliseconds an event over repeated scoring of one stream, after a warm-up."""
    import time

    d = campaign_stream(spark).checkpoint()
    net, n, took = _net(campaign_stream(spark, 97, 30), epochs=2), d.count(), []
    for turn in range(6):
        began = time.perf_counter()
        _scored(d, net).write.format("noop").mode("overwrite").save()
        if turn:
            took.append((1000 * (time.perf_counter() - began) / n,))
    return metrics.latency_percentiles(spark.createDataFrame(took, "ms double"), "ms")


EXPERIMENTS = {"ablation": ablation, "seeds": seeds, "mechanism": mechanism, "relations": relations, "architecture": architecture, "select": select, "capacity": capacity,
               "sharding": sharding, "replicate": replicate, "aperture": aperture, "online": online, "resilience": resilience, "incidents": incident_study, "policies": policy_study,
               "drift": drifts, "bin_concentration": bin_concentration, "frontier": frontier, "saturation": saturation, "latency": latency, "replay": replay,
               "benchmark": benchmark, "ceiling": ceiling, "feature_parity": feature_parity}


def main(args: list[str]) -> int:
    name = args[0] if args else "ablation"
    if name not in EXPERIMENTS:
        print(f"unknown experiment {name}; known: {', '.join(EXPERIMENTS)}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    ensure_checkpoint(spark)
    out = EXPERIMENTS[name](spark)
    write_csv(out, args[1] if len(args) > 1 else f"results/{name}")
    out.show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
