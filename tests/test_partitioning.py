"""Links that routings keep, against plain loops, and no row a link on the way."""

import random

import numpy as np
from pyspark.sql import functions as F

from tollgate.operators import links, partitioning, windows

SCHEMA = "seq long, ts_s double, device_id string, ip_id string, label int, shards array<int>"
RELS = ("device_id", "ip_id")


def rows(n=300, seed=7):
    r = random.Random(seed)
    return [(i, float(t), f"d{r.randrange(4)}", r.choice(["i1", "i2", " UNK ", None]), r.randrange(2), r.sample(range(4), r.randrange(4)) if i % 9 else None) for i, t in enumerate(sorted(r.randrange(150) for _ in range(n)))]


def test_links_kept_are_counted_where_found(spark, monkeypatch):
    monkeypatch.setattr(windows, "STEP_ROWS", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    e = [(r.rel, r.src, r.dst) for r in links.edges(df, RELS, 30.5, 5).collect()]
    places = {x[0]: set(x[5] or ()) for x in data}
    got = partitioning.edges_surviving(df, F.col("shards"), RELS, 30.5, 5)
    assert not any(w in got._jdf.queryExecution().toString() for w in ("Join", "Generate explode(l"))
    assert {(r.rel, r.edges, r.kept) for r in got.collect()} == {(k, sum(x[0] == k for x in e), sum(x[0] == k and bool(places[x[1]] & places[x[2]]) for x in e)) for k in RELS}
    one = partitioning.edges_preserved(df, F.when(F.col("seq") % 5 > 0, F.col("seq") % 3), RELS, 30.5, 5)
    of = {x[0]: x[0] % 3 if x[0] % 5 else None for x in data}
    assert {(r.rel, r.edges, r.kept) for r in one.collect()} == {(k, sum(x[0] == k for x in e), sum(x[0] == k and of[x[1]] is not None and of[x[1]] == of[x[2]] for x in e)) for k in RELS}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shared_score_counts_links_by_search(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = links.shared_entity_score(df, RELS, 30.5, 5, ("label",)).select("seq", "shared")
    assert "Window" not in got._jdf.queryExecution().toString()
    want = {x[0]: 0.0 for x in data}
    for k in (2, 3):
        for i, b in enumerate(data):
            if b[k] not in (None, " UNK "):
                same = [a for a in data if a[k] == b[k] and a[4] == b[4]]
                near = [a for a in same if a[0] < b[0]][-5:]
                want[b[0]] += sum(a[1] >= b[1] - 30.5 for a in near) / np.log1p(len(same))
    for r in got.collect():
        assert abs(r.shared - want[r.seq]) < 1e-9
