"""Invariants: ties, prefixes, caps, quarantine, streaming against batch."""

import random

from pyspark.sql import functions as F

from tollgate.functions.features import entity_key, reasons
from tollgate.operators import components, incidents, links, metrics, windows
from tollgate.sources.attempts import RELATIONS
from tollgate.streaming.velocity import replay

SCHEMA = "seq long, ts_s double, amount double, approved boolean, device_id string, ip_id string, bin_id string, email_domain string, score double, label int"


def rows(n=300, seed=0):
    r = random.Random(seed)
    return [(i, float(t), r.uniform(1, 99), r.random() > 0.2, f"d{r.randrange(9)}", f"i{r.randrange(30)}", f"b{r.randrange(3)}", "gmail", r.random(), r.randrange(2))
            for i, t in enumerate(sorted(r.randrange(400) for _ in range(n)))]


def brute_counts(data, w):
    return {a[0]: sum(b[4] == a[4] and b[1] >= a[1] - w for b in data[:i + 1]) for i, a in enumerate(data)}


def test_trailing_count_with_ties_and_prefix(spark):
    data = rows()
    for part in (data, data[:120]):
        got = {r.seq: r.c for r in spark.createDataFrame(part, SCHEMA).select("seq", windows.trailing_count("device_id", 50).alias("c")).collect()}
        assert got == brute_counts(part, 50)


def test_links_are_past_capped_and_in_window(spark):
    data = rows()
    got = {(r.src, r.dst) for r in links.edges(spark.createDataFrame(data, SCHEMA), ("device_id",), 40, 3).collect()}
    want = set()
    for i, a in enumerate(data):
        want |= {(b[0], a[0]) for b in [b for b in data[:i] if b[4] == a[4] and b[1] >= a[1] - 40][-3:]}
    assert got == want


def test_trailing_rate(spark):
    data = rows()
    got = {r.seq: r.rate for r in windows.trailing_rate(spark.createDataFrame(data, SCHEMA), ~F.col("approved"), 50).collect()}
    for i, a in enumerate(data):
        seen = [b for b in data[:i + 1] if b[1] >= a[1] - 50]
        assert abs(got[a[0]] - sum(not b[3] for b in seen) / len(seen)) < 1e-12


def test_nan_never_alerts(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 0.5), (4, 0.9)], "seq int, score double")
    assert [r.seq for r in df.where(metrics.alert(F.col("score"), 0.5)).collect()] == [3, 4]


def test_quarantine(spark):
    bad = [(1, float("nan"), 1.0, True, "d", "i", "b", "m", 0.1, 0), (2, 1.0, None, True, "d", "i", "b", "m", 0.1, 0), (3, 1.0, 1.0, None, "d", "i", "b", "m", 0.1, 0), (4, 1.0, 1.0, True, " UNK", "", "n/a", "-", 0.1, 0), (5, 1.0, 1.0, True, "d", None, None, None, 0.1, 0)]
    df = spark.createDataFrame(bad, SCHEMA)
    got = {r.seq: r.r for r in df.select("seq", reasons(df).alias("r")).collect()}
    assert got == {1: ["ts_s not finite"], 2: ["amount not finite"], 3: ["approved is null"], 4: ["no usable entity"], 5: []}
    assert df.select(entity_key(F.lit("  None\t")).alias("k")).first().k is None


def test_components_match_union_find(spark):
    r = random.Random(3)
    members = [(i, f"g{r.randrange(60)}") for i in range(100) for _ in range(r.randint(1, 2))]
    par = {i: i for i, _ in members}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    first = {}
    for i, g in members:
        a, b = find(i), find(first.setdefault(g, i))
        par[max(a, b)] = min(a, b)
    got = {x.seq: x.component for x in components.label(spark.createDataFrame(members, "seq long, grp string")).collect()}
    assert got == {i: find(i) for i in par}


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert links.edges(df, RELATIONS, 10).count() == 0
    assert metrics.average_precision(df, "score", "label").first()[0] is None
    assert incidents.incidents(df.withColumn("campaign_id", F.lit("x")), metrics.alert(F.col("score"), 0.5), RELATIONS).count() == 0


def test_risk_fit_orders_classes():
    import numpy as np

    x = np.c_[np.r_[np.zeros(20), np.ones(20)], np.ones(40)]
    mean, scale, w = incidents.fit_risk(x, np.r_[np.zeros(20), np.ones(20)])
    assert w[0] > 0 and abs(w[1]) < 1e-6


def test_stream_matches_batch(spark, tmp_path):
    data = rows(120)
    src = tmp_path / "src"
    for k in range(3):
        spark.createDataFrame(data[40 * k:40 * k + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    replay(stream, str(tmp_path / "cp"), str(tmp_path / "state"), str(tmp_path / "out"), "device_id", 50)
    got = {r.seq: r["count"] for r in spark.read.parquet(str(tmp_path / "out/scored")).collect()}
    assert got == brute_counts(data, 50)


def test_running_totals_and_quantiles_over_ranges(spark):
    r = random.Random(9)
    data = [(k, float(r.randrange(400)) if k != "d" else None) for k in "aaaabbbcd" for _ in range(90 if k != "c" else 1)]
    df = spark.createDataFrame(data, "k string, x double")
    got = {x.k: (x.median, x.low, x.high) for x in metrics.quantiles(df, ["k"], "x").collect()}
    want = {x.k: (x.a, x.b, x.c) for x in df.groupBy("k").agg(*[F.percentile("x", F.lit(q)).alias(n) for q, n in ((0.5, "a"), (0.025, "b"), (0.975, "c"))]).collect()}
    assert got == want and got["d"] == (None, None, None)
    g = df.where("x is not null").groupBy("x").agg(F.count("*").alias("m"))
    at = 0
    for x in metrics.running(g, "x", ("m",), parts=7).orderBy("x").collect():
        at += x.m
        assert x.upto_m == at and x.total_m == g.agg(F.sum("m")).first()[0]
    assert metrics.average_precision(df.limit(0).selectExpr("x", "1 as y"), "x", "y").first()[0] is None
    assert metrics.threshold_costs(df.limit(0).selectExpr("x", "1 as y"), "x", "y").count() == 0
