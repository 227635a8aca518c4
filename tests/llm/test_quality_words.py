"""Words that a scorer's memo lacks are hashed together: the same sums, and a small memo."""

import random

import numpy as np
import pytest
import xxhash

from tollgate.llm import quality


def test_short_hashes_are_xxh32():
    r = np.random.default_rng(1)
    for n in range(1, 16):
        rows = r.integers(0, 256, (50, n), np.uint8)
        for seed in (0, 3, 4):
            assert quality.short_hashes(list(rows.T), seed).tolist() == [xxhash.xxh32_intdigest(x.tobytes(), seed=seed) for x in rows]


@pytest.mark.parametrize("new, memo", [(1, 2000), (7, 2000), (4000, 24 << 20)])
def test_scores_with_few_words_at_once(spark, monkeypatch, new, memo):
    r = random.Random(2)
    words = ["".join(r.choices("abcXYZ019-<>.é漢", k=r.choice((1, 2, 3, 9, 40, 250)))) for _ in range(120)]
    texts = [None, "", " \n ", "a", *[" ".join(r.choices(words, k=r.randrange(60))) for _ in range(80)]]
    scalar = np.random.default_rng(3).normal(0, 5, quality.BUCKETS)
    got = {}

    def run(self, body, schema):
        got["body"] = body

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", run)
    monkeypatch.setattr(quality, "NEW", new)
    monkeypatch.setattr(quality, "MEMO_BYTES", memo)
    quality.score(docs, (scalar, 0.25))
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    out = [s for b in got["body"]([batch.slice(0, 30), batch.slice(30), batch.slice(0, 0)]) for s in b.column(1).to_pylist()]
    for t, s in zip(texts, out, strict=True):
        f = [scalar[x] for w in (t or "").split() for part in quality.slices(w) for x in part]
        z = (np.mean(f) if f else 0.0) + 0.25
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9
    held = next(v for v in quality.held.__globals__["_held"].values())
    assert len(held) * 180 <= max(memo, 2 * new * 600) and not held.new


def test_memo_of_words_is_small():
    """Two workers of an executor share what 3000 MB leave beside its heap."""
    assert quality.MEMO_BYTES <= 32 << 20
