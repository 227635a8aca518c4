"""Per-transaction gradient-boosted trees: no links, the baseline of the relational network."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

FEATURES = ("amount", "log_amount", "hour", "approved", "small", "free_mail")


def fit(df: DataFrame, columns: tuple[str, ...] = FEATURES, trees: int = 50, depth: int = 5, rate: float = 0.1, seed: int = 0):
    """A model of label from columns, with both classes given the same weight in all."""
    n = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(n) < 2:
        raise ValueError("both classes are needed")
    half = sum(n.values()) / 2
    d = df.withColumn("weight_", F.when(F.col("label") == 1, half / n[1]).otherwise(half / n[0])).withColumn("label_", F.col("label").cast("double"))
    d = VectorAssembler(inputCols=list(columns), outputCol="x_", handleInvalid="keep").transform(d)
    return GBTClassifier(featuresCol="x_", labelCol="label_", weightCol="weight_", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(d)


def score(df: DataFrame, model, columns: tuple[str, ...] = FEATURES, out: str = "score") -> DataFrame:
    d = model.transform(VectorAssembler(inputCols=list(columns), outputCol="x_", handleInvalid="keep").transform(df))
    return d.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)
