"""Remaining attempts of an incident: boosted regression stumps under quantile loss, with a conformal pad."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def _stump(x: np.ndarray, grad: np.ndarray, least: int):
    """The split (feature, edge) that best fits the gradient by squares; None if no side may be that small."""
    best = None
    for f in range(x.shape[1]):
        o = np.argsort(x[:, f], kind="stable")
        xs, c = x[o, f], np.cumsum(grad[o])
        n = np.arange(1, len(o))
        gain = c[:-1] ** 2 / n + (c[-1] - c[:-1]) ** 2 / (len(o) - n)
        gain[(xs[1:] == xs[:-1]) | (n < least) | (len(o) - n < least)] = -1
        if len(gain) and (j := int(gain.argmax())) >= 0 and gain[j] > 0 and (best is None or gain[j] > best[0]):
            best = (gain[j], f, (xs[j] + xs[j + 1]) / 2)
    return best


class Quantile:
    def __init__(self, q: float, trees: int = 250, rate: float = 0.06, least: int = 8):
        self.q, self.trees, self.rate, self.least = q, trees, rate, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Quantile":
        self.base, self.steps = float(np.quantile(y, self.q)), []
        at = np.full(len(y), self.base)
        for _ in range(self.trees):
            best = _stump(x, np.where(y > at, self.q, self.q - 1), self.least)
            if best is None:
                break
            _, f, e = best
            left = x[:, f] <= e
            a, b = (float(np.quantile((y - at)[m], self.q)) * self.rate for m in (left, ~left))
            at += np.where(left, a, b)
            self.steps.append((f, e, a, b))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, e, a, b in self.steps:
            out += np.where(x[:, f] <= e, a, b)
        return out


class Forecaster:
    """Median and padded upper quantile; streams are split 60 / 40 into fitting and padding."""

    def fit(self, x, y, stream, seed: int = 0) -> "Forecaster":
        x, y, stream = np.asarray(x, float), np.asarray(y, float), np.asarray(stream)
        ids = np.random.default_rng(seed).permutation(np.unique(stream))
        fit = np.isin(stream, ids[:max(1, int(round(0.6 * len(ids))))])
        self.mid, self.high = Quantile(0.5).fit(x[fit], y[fit]), Quantile(0.9).fit(x[fit], y[fit])
        rest = ~fit if (~fit).any() else fit
        self.pad = max(float(np.quantile(y[rest] - self.high.predict(x[rest]), 0.9)), 0.0)
        return self

    def predict(self, x) -> tuple[np.ndarray, np.ndarray]:
        x = np.asarray(x, float)
        if not hasattr(self, "mid"):
            return np.zeros(len(x)), np.zeros(len(x))
        p50 = np.maximum(self.mid.predict(x), 0)
        return p50, np.maximum(self.high.predict(x) + self.pad, p50)


    def score(self, df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        """df with p50 and p90 from the feature columns, in the executors."""
        me = self

        @F.pandas_udf("p50 double, p90 double")
        def both(x: pd.DataFrame) -> pd.DataFrame:
            mid, high = me.predict(x.to_numpy(float))
            return pd.DataFrame({"p50": mid, "p90": high})

        return df.withColumn("f_", both(F.struct(*columns))).select(*df.columns, "f_.p50", "f_.p90")


def evaluate(df: DataFrame, cost: float = 73.0) -> DataFrame:
    """Coverage of the upper quantile and errors of the median, for rows with remaining, p50 and p90."""
    off = F.abs(F.col("remaining") - F.col("p50"))
    return df.agg(F.count("*").alias("n_snapshots"), F.avg((F.col("remaining") <= F.col("p90")).cast("double")).alias("coverage_upper"), F.avg(off).alias("mae_p50"), F.percentile(off, F.lit(0.5)).alias("median_abs_err_p50"),
                  F.avg("remaining").alias("mean_true_remaining"), F.avg("p50").alias("mean_p50"), F.avg("p90").alias("mean_upper"), (F.avg(off) * cost).alias("mae_exposure"))
