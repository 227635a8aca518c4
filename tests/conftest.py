import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Threaded OpenBLAS can block for good in a process that has forked (a JVM, Spark's workers).
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
         .config("spark.sql.session.timeZone", "UTC").config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('ckpt')}").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
