"""Queries without SQL against plain versions of the same contract, over small fixtures."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tollgate.llm import decontaminate, neardup, packing
from tollgate.llm.tokens import Encoder

DOCS = "doc_id long, text string"


def least_distance(item, text):
    """Least edit distance of item to a stretch of text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, e in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
    return min(row)


@pytest.mark.parametrize("chars", [decontaminate.GROUP_CHARS, 100])
def test_decontaminate_query(spark, monkeypatch, chars):
    monkeypatch.setattr(decontaminate, "GROUP_CHARS", chars)
    r = random.Random(3)
    words = "ab cde fghi jk lmnop q rst".split()
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 14)))) for i in range(12)] + [(20, None), (21, ""), (None, "q rst"), (3, "cde jk lmnop q cde jk lmnop q")]
    docs = [(0, None), (1, ""), (2, "ab " * 50)]
    for i in range(3, 90):
        t = list(" ".join(r.choices(words, k=5)) + " " + (r.choice(items)[1] or "") + " " + " ".join(r.choices(words, k=5)))
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("abq. Z")
        docs.append((i, "".join(t)))
    frames = {"documents": spark.createDataFrame(docs, DOCS), "benchmark": spark.createDataFrame(items, "item_id long, text string")}
    monkeypatch.setattr(decontaminate, "table", lambda s, d, name: frames[name])
    got = sorted((x.doc_id, x.item_id, x.distance) for x in decontaminate.op5_decontaminate(spark, "").collect())
    want = []
    for i, t in docs:
        t = decontaminate.plain(t)
        for item, p in items:
            p = decontaminate.plain(p)
            if item is None or not p:
                continue
            if len(p) < decontaminate.SHORT:
                if f" {p} " in f" {t} ":
                    want.append((i, item, 0))
            elif (d := least_distance(p, t)) <= int(len(p) * decontaminate.ERRORS):
                want.append((i, item, d))
    assert got == sorted(want)


@pytest.mark.parametrize("salt_rows", [packing.SALT_ROWS, 7])
def test_packing_query_round_trip(spark, monkeypatch, salt_rows):
    """Pieces put together in order are each text's ids; sequences are gapless and hold each place once."""
    monkeypatch.setattr(packing, "SALT_ROWS", salt_rows)
    r = random.Random(6)
    docs = [(i, " ".join(r.choices("ab cde fgh the of".split(), k=r.choice((0, 3, 40, 700, 9000))))) for i in range(60)] + [(900, None), (901, "")]
    monkeypatch.setattr(packing, "table", lambda *a: spark.createDataFrame([(i, t, 0, "x") for i, t in docs], DOCS + ", bin_ int, ids string"))
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.op10_packing(spark, "").collect()
    end = np.array([2], "<u4").tobytes()
    for (i, _), ids in zip(docs, Encoder(path, True).ids([t or "" for _, t in docs])):
        ids, at = ids + end, 0
        for x in sorted((x for x in got if x.doc_id == i), key=lambda x: x.start):
            assert x.start == at and x.ids_crc32 == zlib.crc32(ids[4 * at:4 * (at + x.length)]) and x.doc_tokens == len(ids) // 4
            at += x.length
        assert 4 * at == len(ids)
    for s in {x.sequence_id for x in got}:
        at = 0
        for x in sorted((x for x in got if x.sequence_id == s), key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 4096


def test_packing_short_texts(spark):
    """Short pieces are packed by their exact lengths: texts of one id fill whole sequences."""
    for lengths in ([1] * 20_000, [1 + i % 64 for i in range(5000)] + [3000] * 40, [29] * 3000, [65] * 30 + [1], [4096, 4095, 1, 1]):
        got = packing.pack(spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, start long, length long")).collect()
        assert sorted(x.doc_id for x in got) == list(range(len(lengths)))
        ends = {}
        for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
            assert x.offset == ends.get(x.sequence_id, 0)
            ends[x.sequence_id] = x.offset + x.length
        assert max(ends.values()) <= 4096 and sorted(ends) == list(range(len(ends)))
        if 65 not in lengths:
            assert len(ends) <= -(-sum(lengths) // 4096) * 1.05 + 1


def test_near_duplicate_link_recall(spark):
    """Pairs just over the threshold, the hardest to find: each is a link of its own, so a lost one shows as two classes."""
    r, data = random.Random(8), []
    for g in range(1500):
        w = [f"w{r.randrange(10**6)}" for _ in range(112)]
        a = w[:102]  # 101 shingles; the second text shares 90 of them and has 10 more: 90 / 111 = 0.81
        data += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(w[11:112]))]
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in data}
    share = [len(sets[2 * g] & sets[2 * g + 1]) / len(sets[2 * g] | sets[2 * g + 1]) for g in range(1500)]
    assert 0.8 <= min(share) and max(share) < 0.82
    got = {x.doc_id: x.component_id for x in neardup.groups(spark.createDataFrame(data, DOCS).repartition(8), n=2).collect()}
    found = sum(got[2 * g] == got[2 * g + 1] == 2 * g for g in range(1500))
    print("links found", found, "of 1500")
    assert found >= 1499 and len(set(got.values())) == 3000 - found


def test_pipeline_stages_on_hard_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, clashing names, empty tables: each stage has its defined result."""
    import corpus_pipeline
    from tollgate.llm.common import cut

    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    rows = [(1, None, None, 0), (2, "", "s", None), (3, long, "s", 1), (4, long, "s", 2), (5, "x One two, three four five six seven eight nine ten eleven twelve.", "s", 3),
            (6, "Mail jane.roe@mail7.example now", None, 4), (None, "no id", "s", 5), (7, "same id", "s", 6), (7, "another text", "s", 7), (8, "word " * 30000, "s", 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, leaks string, n_chars int").withColumn("new_", F.lit("n")).withColumn("score_", F.lit(1))
    kept = {"quality classifier": {1, 2, 3, 4, 5, 6, 7, 8, None}, "MinHash near-dedup": {1, 2, 3, 5, 6, 7, 8, None}, "benchmark decontamination": {1, 2, 3, 6, 7, 8, None}, "PII": {1, 2, 3, 6, 7, 8, None}}
    none = d.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d, none = cut(stage(spark, d, str(tmp_path))), cut(stage(spark, none, str(tmp_path)))
        assert d.columns == none.columns and none.count() == 0
        got = [x.doc_id for x in d.collect()]
        assert set(got) == kept[name], name
        assert len(got) == len(kept[name]) + (name == "quality classifier")
    text = {x.doc_id: x.text for x in d.collect()}
    assert text[1] is None and text[2] == "" and text[3] == long and text[7] == "another text" and "jane" not in text[6]
    pieces = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).collect()
    assert {x.doc_id for x in pieces} == kept["PII"] and sum(x.length for x in pieces if x.doc_id == 1) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0
