"""Scoring in order of arrival, over rings of the newest rows of each key.

State is a ring a (relation, key): the newest `cap` arrivals with their times and the vectors that
a layer reads. A row meets the ring as it stood when it arrived, so a late row meets all earlier
arrivals that the ring still holds, whatever their times; links are those within the window
before the row's own time. A layer is one stateful operator keyed by (relation, key) and a
stateless one that brings a row's relations together; layers follow one another in one streaming query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.features import entity_key, reasons

#: Ids of linked rows that a result names at most, for each relation.
MOST = 6
LINKED = "seq long, ts_s double, rel string, key string, n int, ids array<long>, m array<double>, h array<double>, keys array<string>, evidence string"
LAYERED = "seq long, ts_s double, h array<double>, keys array<string>, evidence string"
EVIDENCE = "map<string, struct<value:string, ids:array<long>, total:int>>"
#: Rows that carry an event itself are dealt to so many keys; they leave no state.
CARRIERS = 64


class Ring(StatefulProcessor):
    """Keyed by (rel, key): each row's links among the newest `cap` earlier arrivals, their mean vector and newest ids.

    With a gate (a vector a relation) the mean is weighted by sigmoid(gate . |x_link - x_row|). The
    state of a key is at most `cap` rows; ttl_s (processing time) lets keys go that stay silent.
    """

    def __init__(self, window_s: float, cap: int, gates: dict | None = None, ttl_s: float | None = None):
        self.window_s, self.cap, self.gates, self.ttl_s = window_s, cap, gates, ttl_s

    def init(self, handle) -> None:
        self.ring = handle.getValueState("ring", "seq array<bigint>, ts array<double>, h array<double>", *([int(self.ttl_s * 1000)] if self.ttl_s else []))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values("seq")  # a micro-batch's rows of one key
        if key[0] == "":
            yield d.assign(n=0, ids=[[] for _ in range(len(d))], m=[[] for _ in range(len(d))])[[c.split()[0] for c in LINKED.split(", ")]]
            return
        vectors = np.array(d["h"].tolist(), float)
        old = self.ring.get()
        seq, ts = np.array(old[0] if old else [], "i8"), np.array(old[1] if old else [], float)
        held = np.array(old[2] if old else [], float).reshape(len(seq), -1) if len(seq) else vectors[:0]
        seq, ts, held = np.append(seq, d["seq"]), np.append(ts, d["ts_s"]), np.vstack([held, vectors])
        first, gate, out = len(seq) - len(d), (self.gates or {}).get(key[0]), []
        for j in range(first, len(seq)):
            at = np.arange(max(0, j - self.cap), j)
            at = at[ts[at] >= ts[j] - self.window_s]
            w = np.ones(len(at)) if gate is None else 1 / (1 + np.exp(-(np.abs(held[at] - held[j]) @ np.asarray(gate, float))))
            out.append((len(at), seq[at][::-1][:MOST].tolist(), ((w @ held[at]) / max(w.sum(), 1.0)).tolist()))
        self.ring.update((seq[-self.cap:].tolist(), ts[-self.cap:].tolist(), held[-self.cap:].ravel().tolist()))
        got = d.assign(n=[x[0] for x in out], ids=[x[1] for x in out], m=[x[2] for x in out], h=[[] for _ in out], keys=[[] for _ in out], evidence="")
        yield got[[c.split()[0] for c in LINKED.split(", ")]]

    def close(self) -> None:
        pass


def _combine(relations, layer: dict, first: bool):
    """A row's relations together again: ReLU(W_self h + b + sum of mix * W_r m_r). A micro-batch's partition is held."""

    def run(frames):
        d = list(frames)
        if not d or not sum(map(len, d)):
            return
        d = pd.concat(d)
        own = d[d["rel"] == ""].sort_values("seq").reset_index(drop=True)
        at = dict(zip(own["seq"], range(len(own))))
        h = np.array(own["h"].tolist(), float)
        z, notes = h @ layer["self"].T + layer["bias"], [{} for _ in at]
        for k, rel in enumerate(relations):
            one = d[d["rel"] == rel]
            if len(one):
                rows = [at[s] for s in one["seq"]]
                z[rows] += layer["mix"][k] * (np.array(one["m"].tolist(), float) @ layer["rel"][k].T)
                if first:
                    for i, value, ids, n in zip(rows, one["key"], one["ids"], one["n"]):
                        if n:
                            notes[i][rel] = {"value": value, "ids": [int(x) for x in ids], "total": int(n)}
        own["h"] = np.maximum(z, 0).tolist()
        if first:
            own["evidence"] = [json.dumps(x) for x in notes]
        yield own[[c.split()[0] for c in LAYERED.split(", ")]]

    return run


def _keyed(rows: DataFrame, relations) -> DataFrame:
    """A row for each key that marks no absence, and one that carries the event."""
    some = [F.struct(F.lit(r).alias("rel"), F.col("keys")[i].alias("key")) for i, r in enumerate(relations)]
    one = F.array(F.struct(F.lit("").alias("rel"), F.pmod(F.xxhash64("seq"), F.lit(CARRIERS)).cast("string").alias("key")), *some)
    d = rows.withColumn("x", F.explode(one)).where("x.key is not null")
    empty = lambda c, t: F.when(F.col("x.rel") == "", F.col(c)).otherwise(F.lit(None).cast(t))
    return d.select("seq", "ts_s", "x.rel", "x.key", "h", F.coalesce(empty("keys", "array<string>"), F.array().cast("array<string>")).alias("keys"), F.coalesce(empty("evidence", "string"), F.lit("")).alias("evidence"))


def scored(stream: DataFrame, net, features, feature_cols: tuple[str, ...], threshold: float, ttl_s: float | None = None) -> DataFrame:
    """seq, ts_s, score, alert, linked, evidence of a stream's rows that can be scored, by a network of graphnet.

    seq is the order of arrival; within a micro-batch rows are taken in that order, so batches'
    bounds change nothing. Rows with quarantine reasons are left out (see `quarantined`). evidence
    maps a relation to the shared value, the newest ids first (at most MOST) and how many there are.
    Keys that only mark absence link nothing.
    """
    relations = tuple(net.relations)
    good = stream.where(F.size(reasons(stream)) == 0)
    rows = features(good, keep=("ts_s", *relations)).select(
        "seq", "ts_s", F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("h"), F.array(*[entity_key(F.col(r)) for r in relations]).alias("keys"), F.lit("").alias("evidence"))
    for i, layer in enumerate(net.layers):
        gates = dict(zip(relations, layer["gate"])) if layer.get("gate") is not None else None
        linked = _keyed(rows, relations).groupBy("rel", "key").transformWithStateInPandas(
            Ring(net.window_s, net.cap, gates, ttl_s), LINKED, "Append", "ProcessingTime" if ttl_s else "None")
        rows = linked.repartition("seq").mapInPandas(_combine(relations, layer, i == 0), LAYERED)
    logit = sum((F.get("h", F.lit(j)) * float(w) for j, w in enumerate(net.head)), F.lit(net.bias))
    got = rows.withColumn("score", 1 / (1 + F.exp(-logit))).withColumn("evidence", F.from_json("evidence", EVIDENCE))
    total = F.aggregate(F.map_values("evidence"), F.lit(0), lambda a, x: a + x["total"])
    return got.select("seq", "ts_s", "score", (F.col("score") >= threshold).alias("alert"), total.alias("linked"), "evidence")


def quarantined(stream: DataFrame) -> DataFrame:
    """The rows that `scored` leaves out, with their reasons."""
    why = reasons(stream)
    return stream.withColumn("reasons", why).where(F.size("reasons") > 0)


def start(df: DataFrame, path: str, checkpoint: str, **trigger):
    """A streaming query that appends to Parquet at path; by default it runs to the end of what is there."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
