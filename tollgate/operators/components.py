"""Connected components of a bipartite graph of rows and groups, by least labels with jumps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, functions as F


def ensure_checkpoint(spark) -> None:
    """The session's checkpoint folder. Where none is set, a temporary one in local mode and an error on a cluster, whose executors would not see it."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tollgate-"))


def label(members: DataFrame, rounds: int = 60) -> DataFrame:
    """seq, component (least seq reachable) for members (seq, grp): each round takes the least label of a
    row's groups, then that label's own label, so distances halve. Cut by checkpoint() every round."""
    ensure_checkpoint(members.sparkSession)
    members = members.checkpoint()
    lab = members.select("seq").distinct().withColumn("component", F.col("seq")).checkpoint()
    for _ in range(rounds):
        low = members.join(lab, "seq").groupBy("grp").agg(F.min("component").alias("m"))
        new = members.join(low, "grp").groupBy("seq").agg(F.min("m").alias("m"))
        jump = lab.select(F.col("seq").alias("m"), F.col("component").alias("j"))
        new = new.join(jump, "m", "left").join(lab, "seq").select("seq", F.least("component", "m", "j").alias("component"), (F.least("component", "m", "j") < F.col("component")).alias("moved")).checkpoint()
        lab = new.select("seq", "component")
        if new.where("moved").isEmpty():
            return lab
    raise RuntimeError("label: no fixed point; raise rounds")
