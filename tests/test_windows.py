"""Sweeps along sorted rows: bounds against plain loops, over many small steps, and no frame that is summed anew a row."""

import random

import pytest
from pyspark.sql import functions as F

from tollgate.operators import windows

SCHEMA = "seq long, ts_s double, a boolean, device_id string, ip_id string"


def rows(n=400, seed=5):
    r = random.Random(seed)
    return [(i, float(t), r.choice([True, False, False, None]), f"d{r.randrange(4)}", r.choice(["i1", "i2", " UNK ", None])) for i, t in enumerate(sorted(r.randrange(200) for _ in range(n)))]


@pytest.fixture
def small(spark, monkeypatch):
    """Steps of few rows, so that ties, windows and groups go over their edges."""
    monkeypatch.setattr(windows, "STEP_ROWS", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("peers", [False, True])
def test_rate_and_ring_of_the_stream(spark, small, peers):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    rate = {r.seq: r.rate for r in windows.trailing_rate(df, F.col("a"), 30.5, peers).collect()}
    ring = {r.seq: (r.alerts, r.first_alert_s, r.since_s) for r in windows.ring_summary(df, F.col("a"), 30.5, peers).collect()}
    assert len(rate) == len(ring) == len(data)
    for i, x in enumerate(data):
        seen = [b for b in data if x[1] - 30.5 <= b[1] <= x[1] and (peers or b[0] <= x[0])]
        hits = [b[1] for b in seen if b[2]]
        assert rate[x[0]] == len(hits) / len(seen)
        assert ring[x[0]] == (len(hits), min(hits, default=None), x[1] - min(hits) if hits else None)


@pytest.mark.parametrize("of", [windows.trailing_rate, windows.ring_summary])
def test_stream_windows_have_no_frames(spark, of):
    plan = of(spark.createDataFrame(rows(), SCHEMA), F.col("a"), 30.5)._jdf.queryExecution().toString()
    assert "Window" not in plan and "mapinarrow" in plan.lower()


def test_counts_by_entity(spark, small):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = windows.counts_by_entity(df, ("device_id", "ip_id"), 30.5)
    assert "Window" not in got._jdf.queryExecution().toString()
    want = {(x[0], e): sum(b[k] == x[k] and b[1] >= x[1] - 30.5 for b in data[:i + 1]) for i, x in enumerate(data) for e, k in (("device_id", 3), ("ip_id", 4)) if x[k] not in (None, " UNK ")}
    assert {(r.seq, r.entity): r.c for r in got.collect()} == want
