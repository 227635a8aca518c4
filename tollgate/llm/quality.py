"""Quality classifier: averaged hashed word and character n-gram vectors, softmax, numpy SGD.

The softmax of two classes over an averaged vector is a logistic of a mean of per-feature
scalars, so scoring keeps one scalar per hash bucket (a fixed 1 MB broadcast) and, per
worker, a bounded memo of each word's sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, drop_cut, held, table

#: Fixed parameters of the model.
BUCKETS, DIM, NGRAMS, EPOCHS, RATE, SEED = 1 << 17, 8, (3, 4), 6, 2.0, 13
#: Labelled rows that training takes at most, and the features of one row at most kept in memory at once.
TRAIN_ROWS = 4000
#: Bytes that a worker's memo of words holds about.
MEMO_BYTES = 24 << 20
#: Words not in the memo that are noted before their features are hashed together.
NEW = 4000
#: Words of more characters stay out of the memo; n-grams of such a word are hashed in slices of so many.
LONG, SLICE = 200, 1 << 16


def slices(word: str) -> Iterator[list[int]]:
    """Buckets of a word and of all 3- and 4-grams of it between bounds, in lists of at most SLICE."""
    yield [xxhash.xxh32_intdigest(word) % BUCKETS]
    s = f"<{word}>"
    for n in NGRAMS:
        end = len(s) - n + 1
        for a in range(0, end, SLICE):
            yield [xxhash.xxh32_intdigest(s[i:i + n], seed=n) % BUCKETS for i in range(a, min(a + SLICE, end))]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a whole text and their shares."""
    words: dict[str, int] = {}
    for w in (text or "").split():
        words[w] = words.get(w, 0) + 1
    counts: dict[int, int] = {}
    for w, n in words.items():
        for part in slices(w):
            for f in part:
                counts[f] = counts.get(f, 0) + n
    u = np.array(sorted(counts), np.int32)
    c = np.array([counts[f] for f in u.tolist()], float)
    return u, c / c.sum() if len(c) else c


def sgd(docs: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Embeddings, softmax layer and bias by stochastic gradient descent; returns a scalar per bucket and a bias."""
    rng = np.random.default_rng(SEED)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    w, b = np.zeros((2, DIM)), np.zeros(2)
    total = max(EPOCHS * len(docs), 1)
    for step, i in enumerate(np.concatenate([rng.permutation(len(docs)) for _ in range(EPOCHS)]) if docs else ()):
        ids, share, y = docs[i]
        rate = RATE * (1 - step / total)
        h = share @ e[ids] if len(ids) else np.zeros(DIM)
        z = w @ h + b
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        back = p @ w
        w -= rate * np.outer(p, h)
        b -= rate * p
        if len(ids):
            e[ids] -= rate * np.outer(share, back)
    return e @ (w[1] - w[0]), float(b[1] - b[0])


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", rows: int = TRAIN_ROWS):
    """Fit on at most `rows` labelled rows (those of smallest id hash) outside the held-out fold.

    The fold is crc32(id as text) mod 3 = 1. Repeated labels of an id: the smallest. With no
    labelled row every score is 0.5.
    """
    crc = F.crc32(F.col("id").cast("string").cast("binary"))
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    lab = lab.groupBy("id").agg(F.min("y").alias("y")).where(crc % 3 != 1).orderBy(F.xxhash64("id"), "id").limit(rows)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def bags(frames: Iterator[pd.DataFrame]):
        for f in frames:
            got = [bag(t) for t in f["text"]]
            yield pd.DataFrame({"id": f["id"], "y": f["y"], "ids": [x.tobytes() for x, _ in got], "share": [s.astype(np.float32).tobytes() for _, s in got]})

    # The sample's side has at most `rows` rows of two numbers: its size is bounded, so it is broadcast.
    got = cut(text.join(F.broadcast(lab), "id").mapInPandas(bags, "id long, y int, ids binary, share binary"), "bags")  # by all tasks at once
    seen = sorted((r["id"], bytes(r["ids"]), bytes(r["share"]), r["y"]) for r in got.toLocalIterator())
    drop_cut(got)
    return sgd([(np.frombuffer(i, np.int32), np.frombuffer(s, np.float32), y) for _, i, s, y in seen])


def short_hashes(columns: list[np.ndarray], seed: int) -> np.ndarray:
    """xxh32 of many strings of the same length below 16, given as columns of their bytes."""
    p1, p2, p3, p4, p5 = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)
    turned = lambda h, n: h << np.uint32(n) | h >> np.uint32(32 - n)
    c = [x.astype(np.uint32) for x in columns]
    h = np.full(len(c[0]), seed + 374761393 + len(c), np.uint32)
    whole = len(c) // 4 * 4
    for i in range(0, whole, 4):
        h = turned(h + (c[i] | c[i + 1] << np.uint32(8) | c[i + 2] << np.uint32(16) | c[i + 3] << np.uint32(24)) * p3, 17) * p4
    for x in c[whole:]:
        h = turned(h + x * p5, 11) * p1
    h = (h ^ h >> np.uint32(15)) * p2
    h = (h ^ h >> np.uint32(13)) * p3
    return h ^ h >> np.uint32(16)


def ascii_sums(words: list[str], scalar: np.ndarray) -> list[complex]:
    """Of each ASCII word the sum of its features' scalars (real) and their count (imaginary), all words at once."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    text = np.frombuffer("".join([f"<{w}>" for w in words]).encode(), np.uint8)
    room = np.repeat(end, size) - np.arange(len(text))  # bytes left in the word, from each one on
    total, count = scalar[[xxhash.xxh32_intdigest(w) % BUCKETS for w in words]], np.ones(len(words))
    for n in NGRAMS:
        at = np.flatnonzero(room >= n)
        of = np.zeros(len(text))
        of[at] = scalar[short_hashes([text[at + i] for i in range(n)], n) % BUCKETS]
        total = total + np.add.reduceat(of, end - size)
        count += np.maximum(size - n + 1, 0)
    return (total + 1j * count).tolist()


class _Memo(dict):
    """Each word's sum of scalars (real) and count of features (imaginary).

    A word that is not there counts nothing and is noted in `new`; settle() gives what it and the rest of `new` come to.
    """

    def __init__(self, scalar):
        self.scalar, self.size, self.new = scalar, 0, []

    def __missing__(self, word):
        self.new.append(word)
        return 0j

    def settle(self, at: list[int]) -> list[complex]:
        """Sums of the stretches of `new` that end at the places in at."""
        words = list(dict.fromkeys(self.new))
        plain = [w for w in words if len(w) <= LONG and w.isascii()]
        got = dict(zip(plain, ascii_sums(plain, self.scalar))) if plain else {}
        for w in words:
            if w not in got:
                got[w] = sum(complex(float(self.scalar[f].sum()), len(f)) for f in slices(w))
        out = [sum(map(got.__getitem__, self.new[lo:hi]), 0j) for lo, hi in zip([0, *at], at)]
        more = {w: v for w, v in got.items() if len(w) <= LONG}
        size = sum(2 * len(w) + 180 for w in more)  # about what entries take
        if self.size + size > MEMO_BYTES:
            self.clear()
            self.size = 0
        self.update(more)
        self.size += size
        self.new = []
        return out


def score(docs: DataFrame, model, id_col="doc_id", text_col="text", keep: tuple[str, ...] = (), out_col="quality_score") -> DataFrame:
    """id, the columns of keep and the score (0 to 1, under out_col), for every row over its whole text.

    Null and empty texts have no features and get the logistic of the bias. A null id is kept.
    """
    scalar, bias = model
    bc = docs.sparkSession.sparkContext.broadcast(scalar)
    stamp = hash((scalar.tobytes(), bias))
    cols = [F.col(c) for c in dict.fromkeys((id_col, text_col, *keep))]
    kept = docs.select(*cols)
    schema = kept.select(*[c for c in dict.fromkeys((id_col, *keep))]).schema
    from pyspark.sql import types as T

    out_schema = T.StructType([*schema.fields, T.StructField(out_col, T.DoubleType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        import pyarrow as pa

        memo = held(("quality", stamp), lambda: _Memo(bc.value))
        for b in batches:
            out, sums, at = [], [], []
            for t in b.column(text_col):
                words, total = (t.as_py() or "").split(), 0j
                for lo in range(0, len(words), NEW):
                    total += sum(map(memo.__getitem__, words[lo:lo + NEW]), 0j)
                    if len(memo.new) >= NEW:
                        *rest, own = memo.settle([*at, len(memo.new)])
                        out += map(complex.__add__, sums, rest)
                        total, sums, at = total + own, [], []
                sums.append(total)
                at.append(len(memo.new))
            out += map(complex.__add__, sums, memo.settle(at))
            z = [(s.real / s.imag if s.imag else 0.0) + bias for s in out]
            out = [1 / (1 + np.exp(-max(min(x, 500), -500))) for x in z]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(out, pa.float64())], names=[*names, out_col])

    return kept.mapInArrow(run, out_schema)


def op2_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    got = score(docs, model)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return got.select("doc_id", F.coalesce(crc % 3 == 1, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"),
                      (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLES: dict = {}
