"""Plans: what may not pass through the driver."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tollgate.llm import common, neardup

ROWS = [(i, " ".join(f"w{(i // 4) * 50 + j}" for j in range(40)) + (" x" if i % 4 == 1 else " y" if i % 4 == 2 else "")) for i in range(40)]
ROWS += [(3, "another text of an id that comes twice"), (None, "no id"), (90, "")]


@pytest.mark.parametrize("stage", ["operator", "pipeline"])
def test_near_duplicates_broadcast_nothing(spark, monkeypatch, stage):
    """Tables as small as these are broadcast unless a join says otherwise."""
    plans = []

    def seen(df, name="cut", cut=common.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    for module in (common, neardup, corpus_pipeline):
        monkeypatch.setattr(module, "cut", seen)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = neardup.groups(docs, n=2) if stage == "operator" else corpus_pipeline.near_duplicates_stage(spark, docs, "")
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastExchange" in p]
    assert got.count() == (len(ROWS) if stage == "operator" else 12)


def test_license_scan_lowers_ascii_texts_in_bytes(spark):
    """Only texts with other characters go through translate(), a look-up a character; none but A-Z change."""
    from tollgate.llm import licenses

    texts = ["MIT License", "ÉCOLE İ K Z", "", None, "ÁZ", "".join(map(chr, range(1, 128)))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", licenses.lowered(F.col("text")).alias("low"))
    assert "lower(" in df._jdf.queryExecution().executedPlan().toString()
    table = str.maketrans(licenses.UPPER, licenses.LOWER)
    assert all(x.low == (x.text or "").translate(table) for x in df.collect())
