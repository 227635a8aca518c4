"""Streaming forms against one batch over the whole stream."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.functions import features
from tollgate.operators import boosting, drift, graphnet, incidents, links
from tollgate.sources import generator as g
from tollgate.streaming import sketch

FEATS = ("f_log_amount", "f_small", "f_approved", "f_hour", "f_free_mail", "f_one")
RELS = ("device_id", "ip_id", "bin_id")


@pytest.fixture(scope="module")
def stream(spark):
    d = g.inject(g.background(spark, 500, 1), [g.Campaign("c0", 80, 8, 3600.0, 1800.0, 0.0)])
    return d.withColumn("score", F.when(F.col("label") == 1, 0.95).otherwise(0.1)).checkpoint()


def test_network_ranks_the_campaign_first(spark, stream):
    d = stream.join(features.node_features(stream), "seq")
    net = graphnet.fit(d, FEATS, RELS, 3600.0, width=8, depth=2, epochs=60)
    got = graphnet.score(d.drop("score"), net, FEATS).select("score", "label").collect()
    order = sorted(got, key=lambda r: -r.score)[:80]
    assert np.mean([r.label for r in order]) > 0.9


def test_gate_weighs_links(spark):
    d = spark.createDataFrame([(0, 0.0, "k", [1.0, 2.0]), (1, 1.0, "k", [3.0, 0.0]), (2, 2.0, "k", [0.0, 1.0])], "seq long, ts_s double, device_id string, x array<double>")
    got = {r.seq: r.h for r in links.message_layer(d, "x", ("device_id",), [[1.0, 0.0]], [0.0], [[[1.0, 1.0]]], [1.0], 10.0, gate=[[0.5, -1.0]]).collect()}
    s = lambda z: 1 / (1 + np.exp(-z))
    w = s(0.5 * 2 - 2)
    assert abs(got[1][0] - (3 + w * 3)) < 1e-9
    a, b = s(0.5 * 1 - 1), s(0.5 * 3 - 1)
    assert abs(got[2][0] - (a * 3 + b * 3) / max(a + b, 1)) < 1e-9
    with pytest.raises(ValueError):
        links.message_layer(d, "x", ("device_id",), [[1.0, 0.0]], [0.0], [], [1.0], 10.0)


def test_sketch_never_underestimates(spark):
    r = random.Random(0)
    rows = [(f"k{r.randrange(400)}", r.uniform(0, 3600.0)) for _ in range(3000)]
    d = spark.createDataFrame(rows, "k string, ts_s double")
    half = d.where("ts_s < 1800"), d.where("ts_s >= 1800")
    whole = sketch.merge(*[sketch.build(x, "k", 3600.0, 512) for x in half])
    got = {x.value: x.estimate for x in sketch.estimate(whole, d, "k", 3599.0, 3600.0, 512).collect()}
    true = {k: sum(1 for v, _ in rows if v == k) for k in got}
    assert all(got[k] >= true[k] for k in true) and np.mean([got[k] - true[k] for k in true]) < 30
    assert sketch.total(whole, 3599.0, 3600.0).first().total == 3000
    # Three slices on, the first three are gone.
    assert sketch.total(whole, 3599.0 + 3 * 450, 3600.0).first().total == sum(t >= 3 * 450 for _, t in rows)
    assert sketch.memory_bytes() == 2048 * 4 * 8 * 8


def test_stored_profile(spark, tmp_path):
    """A profile is built stream by stream, appended and read back; no base stream is needed after."""
    for k in (1, 2, 3):
        drift.profile(drift.signature(g.inject(g.background(spark, 1500, k), [])), F.lit(f"base{k}")).write.mode("append").parquet(f"{tmp_path}/profile")
    base = spark.read.parquet(f"{tmp_path}/profile")
    limit = drift.threshold(base).checkpoint()
    null = [r.psi for r in drift.null_scores(base).collect()]
    assert len(null) == 6 and abs(limit.first()[0] - float(np.quantile(null, 0.95))) < 1e-9
    check = lambda d: drift.check(base, limit, drift.signature(d)).first()
    assert not check(g.inject(g.background(spark, 1500, 1), [])).drifted
    plain = check(g.inject(g.background(spark, 1500, 9), []))
    bad = check(g.inject(g.background(spark, 1500, 9, shapes={**g.SHAPES, "device_id": (0.01, 0.9)}), []))
    assert bad.drifted and bad.psi > 2 * plain.psi and bad.largest_shift == "reuse_device" and bad.reuse_vs_base["reuse_device"] > 2 and set(bad.per_feature) == set(drift.FEATURES)
    assert drift.threshold(base.limit(0)).first()[0] == float("inf") and not drift.check(base.limit(0), drift.threshold(base.limit(0)), drift.signature(g.inject(g.background(spark, 300, 2), []))).first().drifted


def test_boosted_trees(spark, stream):
    d = stream.select("seq", "label").join(features.transaction_features(stream), "seq")
    m = boosting.fit(d, trees=5, depth=3)
    got = boosting.score(d, m).select("score", "label").collect()
    assert np.mean([r.score for r in got if r.label]) > np.mean([r.score for r in got if not r.label]) + 0.3
    with pytest.raises(ValueError):
        boosting.fit(d.where("label = 0"))


def test_fractional_window(spark):
    from tollgate.operators import windows

    d = spark.createDataFrame([(0, 0.0, "k"), (1, 0.6, "k"), (2, 0.9, "k"), (3, 0.9, None)], "seq long, ts_s double, device_id string")
    assert [r.c for r in d.where("seq < 3").withColumn("c", windows.trailing_count("device_id", 0.5)).orderBy("seq").collect()] == [1, 1, 2]
    assert [r.velocity for r in windows.multi_velocity(d, {"device_id": 1}, 0.5).orderBy("seq").collect()] == [0, 0, 1, 0]
    t = spark.createDataFrame([(0, 5.0, False), (1, 5.0, True), (2, 5.0, True)], "seq long, ts_s double, a boolean")
    assert [(r.alerts, r.first_alert_s) for r in windows.ring_summary(t, F.col("a"), 10.0).orderBy("seq").collect()] == [(0, None), (1, 5.0), (2, 5.0)]


def test_dossier(spark):
    d = spark.createDataFrame([("INC-001", 10, 5, 2, 0, 0.75, 12, 3.0, 40.0, "step_up", {"step_up": 1234.0, "monitor": 99999.0}, "monitor")],
                              "incident_id string, n_attempts int, n_devices int, n_ips int, n_bins int, risk double, observed int, p50 double, p90 double, action string, costs map<string,double>, oracle string")
    text = d.select(incidents.dossier().alias("t")).first().t
    assert text.count("\n") == 9 and "INC-001" in text and "2.0, address 5.0, bin 10.0" in text and "wide: review" in text and "1,234 against 99,999" in text and "monitor (another)" in text
