"""Token alignment against a plain version that encodes whole texts, and the relational operator on its own."""

import collections
import glob
import hashlib
import os
import random

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tollgate.llm import alignment, common

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def plain(docs):
    pair, whole_b = alignment.Pair(A, B), sentencepiece.SentencePieceProcessor(model_file=B)
    per, count = [], collections.Counter()
    for i, t in docs:
        a, b, raw = [], [], (" " + (t or "")).encode()
        if t:
            a, b = pair.a.encode(" " + t, add_special_tokens=False).ids, whole_b.encode(t)
            if not b"".join(pair.bytes_a[x] for x in a) == raw == b"".join(pair.bytes_b[x] for x in b):
                a, b = [], []
        spans = []
        for ids, of in ((a, pair.bytes_a), (b, pair.bytes_b)):
            at, out = 0, []
            for x in ids:
                out.append((at, at := at + len(of[x]), x))
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = ["|".join(",".join(str(x) for _, e, x in side if lo < e <= hi) for side in spans) for lo, hi in zip([0, *cuts], cuts)]
        links = [(x, y) for s, e, x in spans[0] for u, v, y in spans[1] if s < v and u < e] if len(a) < 500 else sweep(*spans)
        per.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        count.update(set(links))
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return collections.Counter((i, na, nb, g, len(ls), sum(count[x] == best[x[0]] for x in ls), sum(count[x] for x in ls), h) for i, na, nb, g, ls, h in per)


def sweep(a, b):
    out, j = [], 0
    for s, e, x in a:
        while j and b[j - 1][1] > s:
            j -= 1
        while b[j][1] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][0] < e:
            out.append((x, b[k][2]))
            k += 1
    return out


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 1 << 16])
def test_query_equals_whole_texts(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    got = alignment.op13_token_alignment(spark, SF)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert collections.Counter(map(tuple, got.collect())) == plain(docs)


def test_hard_rows(spark, monkeypatch):
    """Nulls, empties, repeated rows and ids, special tokens, every sort of blank, bytes that a side lacks, a long text, an empty table."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    r = random.Random(4)
    bits = ["a", "word", "Don't", "'s", "12", "x.", ".", ",", "²", ".\r", "{", "\r", "\n", " ", "  ", "   ", "\t", " ", "　", "\x1c", "\x85", "<|endoftext|>", "</s>", "<0x41>", "é", "文字", "🙂", "\x00", "ing", "the"]
    docs = [(i, "".join(r.choices(bits, k=r.randrange(1, 40)))) for i in range(300)]
    docs += [(1, None), (2, ""), (None, "no id"), (None, None), (5, " "), (6, "\n"), (7, "holds ▁ itself"), (8, "▁"), docs[0], docs[0], (9, "ab, cd " * 6000), (10, "z" * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("x")).withColumn("c", F.lit(None).cast("int")).repartition(3)
    got = alignment.by_document(df, A, B)
    assert collections.Counter(map(tuple, got.collect())) == plain(docs)
    assert alignment.by_document(df.limit(0), A, B).count() == 0


def test_each_chunk_of_the_corpus_is_aligned_once(spark, monkeypatch):
    """However many blocks hold it; a block's chunks went through the relational steps each for itself before."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 40_000)
    counts, align = [], alignment.align
    monkeypatch.setattr(alignment, "align", lambda tokens, *a: counts.append(tokens.count()) or align(tokens, *a))
    texts = [r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()][:100]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id long, text string").repartition(2)
    alignment.by_document(df, A, B)
    split = alignment.Pair(A, B).split
    assert counts == [len({c for t in texts if t for c in split(" " + t)})]


def test_disk_is_let_go(spark):
    """Shuffle files and blocks' chunks stayed while later steps wrote theirs."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    splits = lambda: set(glob.glob(common.shared_dir(spark).removeprefix("file:") + "/tollgate/split-*"))
    was, had = shuffles(), splits()
    got = alignment.op13_token_alignment(spark, SF)
    assert not shuffles() - was
    split, = splits() - had
    assert {f for f in os.listdir(split) if f[0] not in "_."} == {"kind=1"}
    assert got.count() and shuffles() - was


def test_groups_text_is_read_and_written():
    r = random.Random(5)
    side = lambda: ",".join(str(r.choice([0, 9, 10, 99, 100, 32000, 50256])) for _ in range(r.randrange(1, 4)))
    text = "".join(f"{side()}|{side()};" for _ in range(300)).encode()
    assert alignment._written(*alignment._read(text))[0] == text and alignment._written(*alignment._read(b""))[0] == b""


def test_texts_split_where_no_token_crosses():
    pair, whole_b = alignment.Pair(A, B), sentencepiece.SentencePieceProcessor(model_file=B)
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()[:60]:
        parts = pair.split(" " + r["text"])
        ok, a, b = pair.encode(parts)
        assert "".join(parts) == " " + r["text"] and all(ok) and len(parts) > len(r["text"].split()) // 2
        assert sum(a, []) == pair.a.encode(" " + r["text"], add_special_tokens=False).ids and sum(b, []) == whole_b.encode(r["text"])


def test_align_needs_no_texts(spark):
    """Keys of any sort; tokens of one side may span several of the other, and cross."""
    token = lambda *x: [{"id": i, "n": n} for i, n in x]
    d = spark.createDataFrame([(7, token((1, 2), (2, 3), (1, 1)), token((5, 1), (6, 4), (5, 1))), (8, token((1, 4)), token((5, 1), (5, 3))), (9, [], [])],
                              "c long, a array<struct<id:int,n:int>>, b array<struct<id:int,n:int>>")
    with alignment.one_deal(spark):
        got = {x.c: (x.n_a, x.n_b, x.groups, x.n_groups, sorted(map(tuple, x.links))) for x in alignment.align(d).collect()}
    assert got == {7: (3, 3, "1,2|5,6;1|5", 2, [(1, 5), (1, 5), (1, 6), (2, 6)]), 8: (1, 2, "1|5,5", 1, [(1, 5), (1, 5)])}
