"""Line deduplication against SQL and against a plain version on hard rows."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tollgate.llm import linededup

SF = "/root/testdata/sf0.001"


def test_query_matches_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(map(tuple, linededup.op11_line_dedup(spark, SF).collect()))
    assert got == sorted(c.execute(linededup.ORACLES["op11_line_dedup"]).fetchall()) and sum(x[2] for x in got)


def hard_rows():
    r = random.Random(0)
    lines = ["Hot line ", " hot LINE", "a", "b", "", " \t", "é", "É x", *[f"w{i}" for i in range(30)]]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(12)))) for i in range(60)]
    # Null and repeated ids, null and empty texts, lines repeated within a text, a whole row repeated, a very long text.
    docs += [(3, None), (None, "Hot line"), (None, "a\nb"), (5, "a\na\na"), (900, ""), (901, "hot line\n" * 20000), docs[0], docs[7]]
    return docs


def plain(docs, keys, least, keep):
    where = collections.defaultdict(list)
    for d in set(docs):
        for p, line in enumerate((d[1] or "").split("\n")):
            if k := linededup.key(line.encode()):
                where[k].append((*keys[d], p, d))
    gone = collections.defaultdict(set)
    for v in where.values():
        if len({x[:2] for x in v}) >= least:
            for x in sorted(v)[keep == "first":]:
                gone[x[3]].add(x[2])
    return collections.Counter((i, t and "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i, t])) for i, t in docs)


@pytest.mark.parametrize("keep,least,batch", [("none", 1, "10000"), ("none", 3, "3"), ("none", 10, "3"), ("first", 1, "3"), ("first", 2, "10000"), ("first", 2, "3"), ("first", 10, "5")])
def test_bitmaps_equal_a_plain_version(spark, keep, least, batch):
    """Small batches make runs span them; 60 tasks make the hot line span tasks."""
    docs = hard_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("keep", F.lit("k")).withColumn("n_lines", F.lit(None).cast("int"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        bitmaps = linededup.keep_bitmaps(df, least, keep)
        got = linededup.apply(df, bitmaps)
        assert got.columns == df.columns
        keys = {(x.i, x.t): (x.doc, x.tx) for x in linededup._keyed(df, "doc_id", "text", F.col("doc_id").alias("i"), df.text.alias("t")).select("i", "t", "doc", "tx").collect()}
        assert collections.Counter((x.doc_id, x.text) for x in got.collect()) == plain(docs, keys, least, keep)
        assert bitmaps.count() == len(set(docs))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_bitmap_form_and_empty_table(spark):
    df = spark.createDataFrame([(i, "same line\nown " + str(i)) for i in range(12)], "doc_id long, text string")
    for x in linededup.keep_bitmaps(df).collect():
        assert (x.n_lines, x.n_dropped, linededup.unpack(x.keep, 2).tolist()) == (2, 1, [False, True])
    assert linededup.keep_bitmaps(df.limit(0)).count() == 0 and linededup.apply(df.limit(0), linededup.keep_bitmaps(df.limit(0))).count() == 0
    assert linededup.keep_bitmaps(df, min_chars=10).agg(F.sum("n_dropped")).first()[0] == 0
    with pytest.raises(ValueError):
        linededup.keep_bitmaps(df, keep="last")
