"""A small relational network: NumPy training on a bounded graph, distributed scoring.

Layers are those of links.message_layer (mean over links, one map per relation, relations
mixed by the softmax of learned attention, ReLU). Training is full-batch Adam on a graph that fits the driver: at most
MAX_ROWS rows, refused beyond it. Scoring runs over any number of rows with the fitted
weights as literals, one shuffle per relation and layer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .links import edges, message_layer, softmax

MAX_ROWS = 200_000
C_MISS, C_FALSE = 73.0, 40.0


@dataclass
class Net:
    layers: list[dict]
    head: np.ndarray
    bias: float
    relations: tuple[str, ...]
    window_s: float
    cap: int


def _mean(x: np.ndarray, src: np.ndarray, dst: np.ndarray, n: int):
    k = np.maximum(np.bincount(dst, minlength=n), 1)[:, None]
    out = np.zeros((n, x.shape[1]))
    np.add.at(out, dst, x[src])
    return out / k


def fit(df: DataFrame, feature_cols: tuple[str, ...], relations: tuple[str, ...], window_s: float, cap: int = 32, width: int = 32, depth: int = 3, epochs: int = 60, rate: float = 0.01, seed: int = 0) -> Net:
    """Minimise the expected cost of misses and false alarms on labelled rows (seq, ts_s, label, features, relations)."""
    if (n := df.count()) > MAX_ROWS:
        raise ValueError(f"training takes at most {MAX_ROWS} rows")
    rows = df.select("seq", "label", *feature_cols).orderBy("seq").collect()
    at = {r["seq"]: i for i, r in enumerate(rows)}
    x0, y = np.array([[float(r[c]) for c in feature_cols] for r in rows]), np.array([float(r["label"]) for r in rows])
    links = {r: ([], []) for r in relations}
    for e in edges(df, relations, window_s, cap).toLocalIterator():
        links[e["rel"]][0].append(at[e["src"]])
        links[e["rel"]][1].append(at[e["dst"]])
    links = {r: (np.array(a, int), np.array(b, int)) for r, (a, b) in links.items()}
    rng, dims = np.random.default_rng(seed), [x0.shape[1]] + [width] * depth
    p = {}
    for l in range(depth):
        p[f"self{l}"], p[f"b{l}"] = rng.normal(0, 1 / np.sqrt(dims[l]), (dims[l + 1], dims[l])), np.zeros(dims[l + 1])
        for r in relations:
            p[f"{r}{l}"] = rng.normal(0, 1 / np.sqrt(dims[l]), (dims[l + 1], dims[l]))
        p[f"att{l}"] = np.zeros(len(relations))
    p["head"], p["hb"] = rng.normal(0, 0.1, width), np.zeros(1)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, epochs + 1):
        xs, means, acts = [x0], [], []
        for l in range(depth):
            mean = {r: _mean(xs[-1], *links[r], n) for r in relations}
            mix = softmax(p[f"att{l}"].tolist())
            z = xs[-1] @ p[f"self{l}"].T + p[f"b{l}"] + sum(m * (mean[r] @ p[f"{r}{l}"].T) for m, r in zip(mix, relations))
            means.append(mean)
            acts.append(z > 0)
            xs.append(np.maximum(z, 0))
        s = 1 / (1 + np.exp(-(xs[-1] @ p["head"] + p["hb"][0])))
        dz = s * (1 - s) * (C_FALSE * (1 - y) - C_MISS * y) / max(n, 1)
        g = {"head": xs[-1].T @ dz, "hb": np.array([dz.sum()])}
        dx = np.outer(dz, p["head"])
        for l in reversed(range(depth)):
            d = dx * acts[l]
            g[f"self{l}"], g[f"b{l}"] = d.T @ xs[l], d.sum(0)
            dx = d @ p[f"self{l}"]
            mix = np.array(softmax(p[f"att{l}"].tolist()))
            pull = np.array([float((d * (means[l][r] @ p[f"{r}{l}"].T)).sum()) for r in relations])
            g[f"att{l}"] = mix * (pull - mix @ pull)
            for share, r in zip(mix, relations):
                g[f"{r}{l}"] = share * (d.T @ means[l][r])
                src, dst = links[r]
                back = share * (d @ p[f"{r}{l}"]) / np.maximum(np.bincount(dst, minlength=n), 1)[:, None]
                np.add.at(dx, src, back[dst])
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    layers = [{"self": p[f"self{l}"], "bias": p[f"b{l}"], "rel": [p[f"{r}{l}"] for r in relations], "mix": softmax(p[f"att{l}"].tolist())} for l in range(depth)]
    return Net(layers, p["head"], float(p["hb"][0]), relations, window_s, cap)


def relation_attention(net: Net) -> dict[str, float]:
    """Each relation's mixing weight, averaged over the layers."""
    return {r: float(np.mean([l["mix"][i] for l in net.layers])) for i, r in enumerate(net.relations)}


def score(df: DataFrame, net: Net, feature_cols: tuple[str, ...], out: str = "score", also: tuple[str, ...] = (), keep_layers: bool = False) -> DataFrame:
    """df with the network's probability; also keeps links within a shard or tenant. Vectors h0_, h1_, ... are kept on
    request, and rows that bring them (streaming state) keep theirs."""
    d = df if "h0_" in df.columns else df.withColumn("h0_", F.array(*[F.col(c).cast("double") for c in feature_cols]))
    for i, l in enumerate(net.layers):
        old, new = f"h{i}_", f"h{i + 1}_"
        held = new in d.columns
        d = message_layer(d.withColumnRenamed(new, "held_") if held else d, old, net.relations, l["self"].tolist(), l["bias"].tolist(), [w.tolist() for w in l["rel"]], l["mix"], net.window_s, net.cap, new, also=also)
        if held:
            d = d.withColumn(new, F.coalesce("held_", new)).drop("held_")
        if not keep_layers and not held:
            d = d.drop(old)
    last = f"h{len(net.layers)}_"
    logit = sum((F.get(last, F.lit(j)) * float(w) for j, w in enumerate(net.head)), F.lit(net.bias))
    got = d.withColumn(out, 1 / (1 + F.exp(-logit)))
    return got if keep_layers else got.drop(*[f"h{i}_" for i in range(len(net.layers) + 1)])
