"""Generators, policies, learned parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.operators import graphnet, metrics, policies
from tollgate.operators.forecast import Forecaster
from tollgate.sources import generator as g


@pytest.fixture(scope="module")
def stream(spark):
    return g.inject(g.background(spark, 1500, 1), [g.Campaign("c0", 150, 12, 3000.0, 3600.0, 0.5, 3)]).cache()


def test_stream_contract(stream):
    rows = stream.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1650)) and all(a.ts_s <= b.ts_s for a, b in zip(rows, rows[1:]))
    c = [r for r in rows if r.label]
    for k in g.SHAPES:
        n = [sum(r[k] == v for r in c) for v in {r[k] for r in c}]
        assert len(n) == 12 and max(n) - min(n) <= 1
    assert not {r.device_id for r in c} & {r.device_id for r in rows if not r.label}


def test_faults(stream):
    assert g.corrupt(stream, "nan_amount", 0.2).where(F.isnan("amount")).count() in range(230, 430)
    with pytest.raises(ValueError):
        g.corrupt(stream, "other", 0.1)


def test_tenants(spark):
    d = g.tenants(spark, 2, 50, g.Campaign("c", 20, 4, 0.0, 100.0))
    assert d.count() == 120 and d.select("merchant_id").distinct().count() == 2


def test_network_ranks_linked_campaigns(stream):
    d = stream.select("seq", "ts_s", "label", "device_id", "ip_id", F.log1p("amount").alias("f1"), F.col("approved").cast("double").alias("f2"), F.lit(1.0).alias("f3"))
    cols, rels = ("f1", "f2", "f3"), ("device_id", "ip_id")
    net = graphnet.fit(d, cols, rels, 3600.0, 8, width=8, depth=2, epochs=80, rate=0.03)
    got = graphnet.score(d, net, cols)
    assert metrics.average_precision(got, "score", "label").first()[0] > 0.6


def test_policies(spark):
    inc = spark.createDataFrame([(1, 20, 0.9, 100.0, 200.0, True, 100), (2, 2, 0.1, 1.0, 3.0, False, 0)], "component long, n_attempts long, risk double, p50 double, p90 double, is_true boolean, remaining long")
    rows = {r.policy: r for r in policies.evaluate(inc).collect()}
    got = {p: r.merchant_cost for p, r in rows.items()}
    assert got["always_allow"] == 7300.0 and got["oracle_policy"] <= min(got.values())
    assert abs(got["always_hold"] - (2 * (900 + 108) + 100 * 73 * 0.03 + 6000)) < 1e-6
    causal, tickets = rows["causal_policy"], rows["event_thresholding"]
    assert tickets.analyst_minutes == 11.0 and abs(tickets.merchant_cost - causal.merchant_cost - 22 * 0.5 * 9) < 1e-6 and tickets.actions_matching_oracle == causal.actions_matching_oracle
    assert rows["oracle_policy"].regret_vs_oracle == 0 and rows["oracle_policy"].actions_matching_oracle == 2 and rows["always_hold"].false_incidents == 1


def test_forecaster_covers():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, (300, 2))
    y = x[:, 0] * 5 + rng.normal(0, 3, 300)
    f = Forecaster().fit(x[:200], y[:200], np.arange(200) % 10)
    mid, high = f.predict(x[200:])
    assert (y[200:] <= high).mean() > 0.8 and np.abs(mid - y[200:]).mean() < 8
