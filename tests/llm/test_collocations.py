"""Collocations against SQL, with ranges and blocks small enough that bounds cut nodes at every depth."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.llm import collocations as C

SF = "/root/testdata/sf0.001"


def sql(docs_sql, least=100, percent=100, top=2000):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS {docs_sql}")
    q = C.ORACLES["op12_collocations"].replace("f >= 100", f"f >= {least}").replace("100 * s.longer < 100 * a", f"100 * s.longer < {percent} * a").replace("rank <= 2000", f"rank <= {top}")
    return sorted(c.execute(q).fetchall())


@pytest.mark.parametrize("range_bytes,block", [(8 << 20, 1 << 21), (1 << 13, 5000)])
def test_query_matches_sql(spark, monkeypatch, range_bytes, block):
    monkeypatch.setattr(C, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(C, "BLOCK_WORDS", block)
    got = sorted(map(tuple, C.op12_collocations(spark, SF).collect()))
    assert got == sql(f"SELECT * FROM '{SF}/documents.parquet'") and len(got) > 20


@pytest.mark.parametrize("least,percent,top", [(2, 100, 2000), (3, 80, 15), (1, 50, 2000)])
def test_hard_rows(spark, monkeypatch, tmp_path, least, percent, top):
    """Null, empty and repeated rows, null languages, languages with blanks, odd characters, one language with most rows, a long text."""
    monkeypatch.setattr(C, "RANGE_BYTES", 1 << 10)
    monkeypatch.setattr(C, "BLOCK_WORDS", 97)
    monkeypatch.setattr(C, "MERGE_ROWS", 50)
    r = random.Random(least)
    words = ["a", "B", "é", "ÉÉ", "x\x00y", "-", "文字", "c d", "\x1c", "zz"]
    docs = [(r.choice(["en"] * 8 + ["fr", None, "a b", "und", ""]), "".join(r.choice(words) + r.choice([" ", "  ", "\t", ". ", "\n", "!?", " ", " "]) for _ in range(r.randrange(40)))) for _ in range(80)]
    docs += [("en", None), ("en", ""), (None, None), ("en", " .,"), ("en", "a b " * 400), ("fr", "only"), docs[0], docs[0]]
    df = spark.createDataFrame([(i, t, g, 0) for i, (g, t) in enumerate(docs)], "doc_id long, text string, lang string, f int").withColumn("words", F.lit("w"))
    df.repartition(3).write.parquet(f"{tmp_path}/d")
    got = sorted(map(tuple, C.collocations(spark.read.parquet(f"{tmp_path}/d"), least, top, percent, salts=3).collect()))
    assert got == sql(f"SELECT * FROM '{tmp_path}/d/*.parquet'", least, percent, top) and len(got) > 30
    assert C.collocations(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts near 10^12, as nodes of a corpus that no test can hold: products take over 64 bits."""
    big = 10 ** 12
    rows = [("en", 0, "", 9 * big + 1, [], True), ("en", 1, "p", big, [-1], False), ("en", 1, "q", big + 7, [-1], False), ("en", 2, "p q", big - 3, [-1, big], False)]
    monkeypatch.setattr(C, "trie_nodes", lambda *a: spark.createDataFrame(rows, C.NODES))
    x, = C.collocations(spark.range(0)).collect()
    assert (x.a, x.l, x.r, x.n, x.score) == (big - 3, big, big + 7, 9 * big + 1, 1000 * (big - 3) * (9 * big + 1) // (big * (big + 7)))


def test_serialised_tries():
    r = np.random.default_rng(0)
    g = r.integers(1, 70000, (500, 6))
    g[:, 1] = g[:, 1] % 5 + 1
    for i, k in enumerate(r.integers(2, 7, 500)):
        g[i, k:] = 0
    g[:, 0] %= 2
    g, n = C._sorted(g.astype("i4"), None)
    a, b = C.decode(C.encode(g, n))
    assert (a == g).all() and (b == n).all()


@pytest.mark.parametrize("shuffles,parts", [(4, 3), (200, 3), (4, 200)])
def test_as_many_ranges_however_rows_lie(spark, monkeypatch, shuffles, parts):
    """With few samples a partition there were no bounds at all, and one task merged everything."""
    monkeypatch.setattr(C, "RANGE_BYTES", 1 << 14)
    texts = C._texts(spark.read.parquet(f"{SF}/documents.parquet"), "lang", "text").repartition(parts)
    conf = {"spark.sql.shuffle.partitions": str(shuffles), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = C.range_bounds(texts)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    assert got == sorted(set(got)) and 0.6 < len(got) / (size / C.RANGE_BYTES) < 1.2
