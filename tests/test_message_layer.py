"""A gated layer over several relations, groups and small steps, against a plain loop."""

import random

import numpy as np

from tollgate.operators import links, windows


def test_layer_against_loop(spark, monkeypatch):
    monkeypatch.setattr(windows, "STEP_ROWS", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    r, g = random.Random(4), np.random.default_rng(4)
    data = [(i, float(t), r.choice(["a", "b", None]), f"d{r.randrange(3)}", r.choice(["i1", "i2", None]), g.normal(size=2).tolist()) for i, t in enumerate(sorted(r.randrange(100) for _ in range(200)))]
    df = spark.createDataFrame(data, "seq long, ts_s double, shop string, device_id string, ip_id string, x array<double>").repartition(3)
    own, bias, rel, mix, gate = g.normal(size=(3, 2)), g.normal(size=3), g.normal(size=(2, 3, 2)), [0.3, 0.7], g.normal(size=(2, 2))
    for also, gates in ((), gate), (("shop",), None):
        got = links.message_layer(df, "x", ("device_id", "ip_id"), own.tolist(), bias.tolist(), rel.tolist(), mix, 20.5, 4, gate=None if gates is None else gates.tolist(), also=also)
        # Vectors are mixed in columns of numbers: no Python call a row.
        assert "arrowevalpython" in (plan := got._jdf.queryExecution().toString().lower()) and "mapinarrow" in plan
        h = {x.seq: x.h for x in got.collect()}
        assert len(h) == len(data)
        for i, b in enumerate(data):
            want = own @ b[5] + bias
            for k, c in enumerate((3, 4)):
                near = [a for a in data[:i] if b[c] and a[c] == b[c] and (not also or a[2] == b[2])][-4:]
                near = [a for a in near if a[1] >= b[1] - 20.5]
                w = [1.0 if gates is None else 1 / (1 + np.exp(-np.abs(np.array(a[5]) - b[5]) @ gates[k])) for a in near]
                if near:
                    want = want + mix[k] * rel[k] @ (sum(v * np.array(a[5]) for v, a in zip(w, near)) / max(sum(w), 1))
            assert np.allclose(h[b[0]], np.maximum(want, 0))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
