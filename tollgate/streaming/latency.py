"""How long a stream's batches take, and its rows: gathered from progress reports as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.metrics import latency_percentiles

BATCHES = "name string, batch long, rows long, ms double"


class Latency(StreamingQueryListener):
    """Listens to queries; `table` gives a row a batch that had rows, `summary` percentiles a batch and a row."""

    def __init__(self):
        self.seen: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.seen.append((p.name, p.batchId, p.numInputRows, float(p.durationMs.get("triggerExecution", 0))))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.seen, BATCHES)

    def summary(self, spark: SparkSession) -> DataFrame:
        """p50, p95, p99 and mean in ms of a batch, and of a row's share of its batch, with how many a second."""
        t = self.table(spark)
        one = latency_percentiles(t, "ms").selectExpr("'batch' as of", "p50", "p95", "p99", "mean", "per_s")
        return one.unionByName(latency_percentiles(t.selectExpr("ms / rows as ms"), "ms").selectExpr("'row' as of", "p50", "p95", "p99", "mean", "per_s"))
