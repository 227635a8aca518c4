"""Stateful streaming operators against plain versions that take one event at a time, in order of arrival."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.functions import features
from tollgate.operators import graphnet
from tollgate.streaming import incidents as online, rings, sketch

RELS = ("device_id", "ip_id")
COLS = ("f_log_amount", "f_small", "f_approved", "f_hour", "f_free_mail", "f_one")
SCHEMA = "seq long, ts_s double, amount double, approved boolean, email_domain string, device_id string, ip_id string, bin_id string, score double"
MARKERS = ("n/a", " UNK ", None, "")


def events(n=150, seed=0):
    """Late rows of up to 400 s, tied times, one device with a third of all rows, markers in place of values, unscoreable rows."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        device = r.choice(["hot", f"d{r.randrange(6)}", f"d{r.randrange(6)}\t", r.choice(MARKERS)])
        out.append((i, float(i * 10 - r.choice((0, 0, 0, 50, 400)) // 10 * 10), math.nan if i % 41 == 7 else 5.0 + r.random() * 60, None if i % 37 == 5 else r.random() < 0.5,
                    r.choice(("gmail.com", "x.org")), device, r.choice([f"i{r.randrange(5)}", r.choice(MARKERS)]), "b", r.choice((0.2, 0.9, 0.95))))
    return out


def source(spark, folder, rows, files=3):
    """A stream of files, each a stretch of arrivals, its rows in another order."""
    size = -(-len(rows) // files)
    for k in range(files):
        part = rows[k * size:(k + 1) * size]
        spark.createDataFrame(random.Random(k).sample(part, len(part)), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def key(x):
    x = (x or "").strip()
    return None if x.lower() in features.ABSENT else x


def net(depth, gated, cap):
    r, dims, layers = np.random.default_rng(depth), [len(COLS)] + [4] * depth, []
    for a, b in zip(dims, dims[1:]):
        layers.append({"self": r.normal(0, 0.5, (b, a)), "bias": r.normal(0, 0.2, b), "rel": [r.normal(0, 0.5, (b, a)) for _ in RELS], "mix": [0.3, 0.7], "gate": [r.normal(0, 0.5, a).tolist() for _ in RELS] if gated else None})
    return graphnet.Net(layers, r.normal(0, 0.5, 4), 0.1, RELS, 300.0, cap)


def plain_scores(rows, n):
    rings_, out = collections.defaultdict(list), {}
    for seq, ts, amount, approved, mail, device, ip, bin_, _ in sorted(rows):
        if approved is None or math.isnan(amount):
            continue
        hs = [np.array([math.log1p(amount), amount < 25, approved, math.floor(ts / 3600) % 24 / 24, mail == "gmail.com", 1.0], float)]
        near, notes = {}, {}
        for rel, value in zip(RELS, map(key, (device, ip))):
            near[rel] = [x for x in rings_[rel, value][-n.cap:] if x[1] >= ts - n.window_s] if value else []
            if near[rel]:
                notes[rel] = (value, [x[0] for x in near[rel][::-1][:rings.MOST]], len(near[rel]))
        for k, layer in enumerate(n.layers):
            z = layer["self"] @ hs[k] + layer["bias"]
            for i, rel in enumerate(RELS):
                if near[rel]:
                    w = np.array([1.0 if layer["gate"] is None else 1 / (1 + np.exp(-np.dot(layer["gate"][i], np.abs(x[2][k] - hs[k])))) for x in near[rel]])
                    z = z + layer["mix"][i] * (layer["rel"][i] @ (sum(a * x[2][k] for a, x in zip(w, near[rel])) / max(w.sum(), 1.0)))
            hs.append(np.maximum(z, 0))
        for rel, value in zip(RELS, map(key, (device, ip))):
            if value:
                rings_[rel, value].append((seq, ts, hs))
        out[seq] = (1 / (1 + math.exp(-(np.dot(n.head, hs[-1]) + n.bias))), notes)
    return out


@pytest.mark.parametrize("depth,gated,cap", [(1, False, 32), (2, True, 4), (3, False, 4)])
def test_scores_in_order_of_arrival(spark, tmp_path, depth, gated, cap):
    rows, n = events(), net(depth, gated, cap)
    stream = source(spark, f"{tmp_path}/in", rows)
    rings.start(rings.scored(stream, n, features.node_features, COLS, 0.6), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got, want = {r.seq: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}, plain_scores(rows, n)
    assert got.keys() == want.keys()
    for s, (score, notes) in want.items():
        assert abs(got[s].score - score) < 1e-9 and got[s].alert == (score >= 0.6)
        assert {k: (v.value, v.ids, v.total) for k, v in got[s].evidence.items()} == notes and got[s].linked == sum(v[2] for v in notes.values())
    # State: no more than cap rows a key, and no key for markers or events.
    kept = spark.read.format("statestore").option("stateVarName", "ring").load(f"{tmp_path}/ck").select("key", F.size("value.seq").alias("n")).collect()
    assert kept and max(r.n for r in kept) <= cap and all(r.key.rel in RELS and key(r.key.key) for r in kept)
    assert any(r.n == cap for r in kept) or cap == 32


def test_quarantine_beside_the_scores(spark, tmp_path):
    rows = events()
    rings.start(rings.quarantined(source(spark, f"{tmp_path}/in", rows)), f"{tmp_path}/q", f"{tmp_path}/ck").awaitTermination()
    bad = {r.seq: r.reasons for r in spark.read.parquet(f"{tmp_path}/q").collect()}
    assert set(bad) == {x[0] for x in rows if x[3] is None or math.isnan(x[2])}


def test_silent_keys_go(spark, tmp_path):
    """A ring that no row touched for its time to live is not met again. (Such a query goes on without data, so rows are waited for.)"""
    import time

    rows = [(i, float(i), 5.0, True, "x.org", "d", "i", "b", 0.5) for i in range(6)]
    folder = f"{tmp_path}/in"
    spark.createDataFrame(rows[:3], SCHEMA).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    q = rings.start(rings.scored(stream, net(1, False, 4), features.node_features, COLS, 0.6, ttl_s=3.0), f"{tmp_path}/out", f"{tmp_path}/ck", processingTime="4 seconds")

    def wait(n):
        for _ in range(120):
            time.sleep(1)
            if q.exception() or (tmp_path / "out" / "_spark_metadata" / "0").exists() and spark.read.schema("seq long, linked int").parquet(f"{tmp_path}/out").count() >= n:
                return

    try:
        wait(3)
        time.sleep(5)
        spark.createDataFrame(rows[3:], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        wait(6)
    finally:
        q.stop()
    got = {r.seq: r.linked for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert [got[i] for i in range(6)] == [0, 2, 4, 0, 2, 4]


def plain_ties(rows, threshold, gap, share, window, slices=8):
    """Union of alerts event by event, with exact counts by slices."""
    parent, seen, held = {}, collections.defaultdict(collections.Counter), collections.defaultdict(list)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    skipped = 0
    for seq, ts, *_, device, ip, _, score in sorted(rows):
        epoch = int(ts // (window / slices))
        if score >= threshold:
            parent[seq] = seq
        for rel, value in zip(RELS, map(key, (device, ip))):
            if not value:
                continue
            seen[rel][epoch, value] += 1
            live = lambda v: sum(n for (e, x), n in seen[rel].items() if epoch - slices < e and (v is None or x == v))  # noqa: B023, E731
            if score < threshold:
                continue
            near = [s for s, t in held[rel, value] if t >= ts - gap]
            if live(value) > share * live(None):
                skipped += 1
            else:
                for s in near:
                    a, b = find(s), find(seq)
                    parent[max(a, b)] = min(a, b)
            held[rel, value] = [(s, t) for s, t in held[rel, value] if t >= ts - gap] + [(seq, ts)]  # what is out of the window once stays out
    return {s: find(s) for s in parent}, skipped


@pytest.mark.parametrize("share", [1.0, 0.3])
def test_merge_log_equals_a_plain_replay(spark, tmp_path, share):
    rows = events(120, 3)
    log = online.run(source(spark, f"{tmp_path}/in", rows), f"{tmp_path}/log", f"{tmp_path}/ck", RELS, 0.9, gap_s=60.0, share=share, window_s=3200.0)
    want, skipped = plain_ties(rows, 0.9, 60.0, share, 3200.0)
    assert {r.seq: r.component for r in log.groups(spark).collect()} == want and 1 < len(set(want.values())) < len(want)
    assert log.stats(spark)["links_skipped_as_common"] == skipped and (skipped > 0) == (share < 1)
    # A batch writes its alerts' links and nothing of the alerts before; after a compaction groups are the same.
    per = {r.batch: r["count"] for r in log._links(spark).groupBy("batch").count().collect()}
    assert set(per) == {0, 1, 2} and max(per.values()) <= 40 * (1 + 3 * len(RELS))
    log.compact(spark, 1)
    assert log._upto(spark) == 1 and {r.seq: r.component for r in log.groups(spark).collect()} == want
    log.compact(spark, 2)
    assert {r.seq: r.component for r in log.groups(spark).collect()} == want


def test_counters_never_underestimate_in_fixed_memory(spark, tmp_path):
    rows = events(120, 5)
    got = sketch.shares(source(spark, f"{tmp_path}/in", rows), RELS, 400.0, width=16)
    rings.start(got, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    seen, want = collections.defaultdict(collections.Counter), {}
    for seq, ts, *_, device, ip, _, _ in sorted(rows):
        epoch = int(ts // 50.0)
        for rel, value in zip(RELS, map(key, (device, ip))):
            if value:
                newest = max([e for e, _ in seen[rel] if e % 8 == epoch % 8], default=epoch)
                if epoch >= newest:  # a later slice takes the place of one of eight before
                    seen[rel] = collections.Counter({k: n for k, n in seen[rel].items() if k[0] % 8 != epoch % 8 or k[0] == epoch})
                    seen[rel][epoch, value] += 1
                live = [(x, n) for (e, x), n in seen[rel].items() if epoch - 8 < e]
                want[seq, rel] = sum(n for x, n in live if x == value), sum(n for _, n in live)
    out = {(r.seq, r.rel): (r.estimate, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out.keys() == want.keys() and all(out[k][0] >= want[k][0] and out[k][1] == want[k][1] for k in want)
    state = spark.read.format("statestore").option("stateVarName", "counters").load(f"{tmp_path}/ck").select(F.octet_length("value.cells").alias("n")).collect()
    assert [r.n for r in state] == [4 * 8 * 16] * (4 * len(RELS))


def test_counters_memory_over_many_batches():
    """The operator's body alone, over 1,000 batches: its state keeps its size."""
    import pandas as pd

    class State:
        value = None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    c = sketch.Counters(80.0, width=32)
    c.state, r, sizes = State(), random.Random(1), set()
    for b in range(1000):
        d = pd.DataFrame({"seq": range(b * 5, b * 5 + 5), "ts_s": [b + 0.1] * 5, "bucket": [r.randrange(32) for _ in range(5)]})
        got = pd.concat(list(c.handleInputRows(("r", 0), iter([d]), None)))
        sizes.add(sum(map(len, c.state.value)))
    assert len(sizes) == 1 and got["total"].iloc[-1] == 5 * (1 + 999 - 999 // 10 * 10 + 70)
