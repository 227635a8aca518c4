"""Damaged lines of JSON in a stream, counted as they pass, and how long its batches take."""

import math

import pytest
from pyspark.sql import functions as F

from tollgate.functions import features
from tollgate.sources import json_lines
from tollgate.streaming import latency, rings

GOOD = '{"seq": 1, "ts_s": 5.0, "amount": 3, "approved": true, "email_domain": "x.org", "device_id": " d1 ", "ip_id": null, "bin_id": "n/a"}'
LINES = {
    GOOD: [], GOOD.replace("3,", '"3.5",'): [], GOOD.replace("3,", "NaN,"): ["amount not finite"], GOOD.replace("5.0", '"soon"'): ["ts_s not finite"], GOOD.replace('"amount": 3, ', ""): ["missing field amount"],
    GOOD.replace("true", "null"): ["approved is null"], GOOD[:-1]: ["malformed record"], "": ["malformed record"], "[1]": ["malformed record"], GOOD.replace('"x.org"', '"-"').replace(" d1 ", "UNK"): ["no usable entity"],
    '{"ts_s": 1}': [f"missing field {f}" for f in features.REQUIRED if f != "ts_s"] + ["no usable entity"],
}


def test_reasons(spark):
    d = json_lines.parse(spark.createDataFrame([(x,) for x in LINES] + [(None,)], "value string"))
    got = {r.raw: r.reasons for r in d.collect()}
    assert got == {**LINES, None: ["malformed record"]}
    row = d.where(F.col("raw") == GOOD).first()
    assert (row.seq, row.ts_s, row.amount, row.approved, row.device_id) == (1, 5.0, 3.0, True, " d1 ")


def test_stream_counts_and_latency(spark, tmp_path):
    heard = latency.Latency()
    spark.streams.addListener(heard)
    try:
        for k in range(3):
            spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/in")
        rows = json_lines.counted(json_lines.parse(spark.readStream.option("maxFilesPerTrigger", 1).text(f"{tmp_path}/in")))
        q = rings.start(rows, f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination()
        n = json_lines.totals(q.recentProgress)
        lines = spark.read.text(f"{tmp_path}/in").count()
        assert n["seen"] == lines == 3 * len(LINES) and n["malformed record"] == 9 and n["missing field amount"] == 6 and n["quarantined"] == 3 * (len(LINES) - 2)
        for _ in range(50):
            if len(heard.seen) >= 3:
                break
            import time

            time.sleep(0.1)
        assert [x[2] for x in heard.seen] == [len(LINES)] * 3
        got = {r["of"]: r for r in heard.summary(spark).collect()}
        assert 0 < got["row"].p50 <= got["row"].p99 <= got["batch"].p99 and math.isclose(got["batch"].p50, sorted(x[3] for x in heard.seen)[1])
    finally:
        spark.streams.removeListener(heard)


def test_csv_refuses_and_joins(spark, tmp_path):
    from tollgate.sources import attempts

    (tmp_path / "t.csv").write_text("TransactionID,TransactionDT,card1\n1,5.0,b1\n2,6.0,b2\n3,7.0,b3\n")
    (tmp_path / "i.csv").write_text("TransactionID,DeviceInfo\n1,phone\n3,tablet\n")
    cols = {"TransactionID": "long", "TransactionDT": "double", "card1": "string"}
    got = attempts.read_csv(spark, f"{tmp_path}/t.csv", cols, identity=(f"{tmp_path}/i.csv", {"TransactionID": "long", "DeviceInfo": "string"}, "TransactionID"))
    assert sorted(map(tuple, got.collect()))== [(1, 5.0, "b1", "phone"), (2, 6.0, "b2", None), (3, 7.0, "b3", "tablet")]
    with pytest.raises(NotImplementedError, match="DeviceInfo"):
        attempts.read_csv(spark, f"{tmp_path}/t.csv", {**cols, "DeviceInfo": "string"})
