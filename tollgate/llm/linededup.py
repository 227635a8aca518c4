"""Line deduplication that returns keep bitmaps: hashes of lines, range-partitioned, in one streaming pass.

Rows (hash, document, position) are dealt by ranges of (hash, document) and sorted by position
within, so a line that a third of all documents share is spread over as many tasks as its rows
need. Each task streams its runs of equal hashes and settles those that it holds whole. Only its
first and last run may go on in a neighbour; their rows are settled by totals, of which every
task hands in two at most. Texts stay where they are: what comes back is a compressed bitmap a
document, which `apply` lays over the texts.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, drop_cut, table

# What is stripped at both ends of a line.
BLANK = b" \t\n\v\f\r"
LINES = "h1 long, h2 long, doc long, tx long, pos int"
#: kind 0: a dropped line; 1: a line of a run at a task's edge; 2: the documents of such a run in that task (pos 1 if that task settled its start).
OUT = "kind int, h1 long, h2 long, doc long, tx long, pos int, n long"


def key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes: A-Z alone


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """doc, tx: a document is a distinct pair of id and text. Null ids count as an id of their own."""
    i = F.col(id_col).cast("long")
    return docs.select(F.coalesce(i, F.lit(0)).alias("doc"), F.xxhash64(i, F.col(text_col)).alias("tx"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *more)


def lines(docs: DataFrame, id_col="doc_id", text_col="text", min_chars: int = 1) -> DataFrame:
    """A row for each line whose key has min_chars code points or more, with the key's 128-bit hash; and one for
    each document, with null hashes and its number of lines as pos."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            docs_, txs = b.column("doc").to_numpy(zero_copy_only=False), b.column("tx").to_numpy(zero_copy_only=False)
            for i, text in enumerate(b.column("text").to_pylist()):
                keys = [x.strip(BLANK) for x in text.lower().split(b"\n")]
                at = [j for j, k in enumerate(keys) if k and (min_chars < 2 or len(k.decode("utf-8", "replace")) >= min_chars)]
                h = np.frombuffer(b"".join([digest(keys[j]) for j in at]), "<i8").reshape(-1, 2)
                n = len(at) + 1
                some = np.arange(n) < n - 1
                yield pa.record_batch([pa.array(np.append(h[:, 0], 0), mask=~some), pa.array(np.append(h[:, 1], 0), mask=~some), pa.array(np.full(n, docs_[i])),
                                       pa.array(np.full(n, txs[i])), pa.array(np.array([*at, len(keys)], "i4"))], names=["h1", "h2", "doc", "tx", "pos"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, LINES)


def _stream(min_docs: int, first: bool):
    """Over rows sorted by (h1, h2, doc, tx, pos): settles runs, carrying the open one from batch to batch.

    Of an open run, rows are held only while fewer than min_docs documents are known; beyond
    that they leave at once, so a run of any length takes little memory.
    """

    def run(batches):
        held, count, edge, last, begun = None, 0, True, None, False  # rows that wait, documents so far, at the edge?, last row, any row seen

        def out(kind, rows, n=None):
            k = len(rows)
            n = np.zeros(k, "i8") if n is None else n
            cols = [np.full(k, kind, "i4"), *(rows[:, j] for j in range(4)), rows[:, 4].astype("i4"), n]
            return pa.record_batch([pa.array(c) for c in cols], names=["kind", "h1", "h2", "doc", "tx", "pos", "n"])

        def total(row, n, settled):
            return out(2, np.array([[*row[:4], settled]], "i8"), np.array([n], "i8"))

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype("i8") for c in ("h1", "h2", "doc", "tx", "pos")], 1)
            if last is None:
                shift = np.vstack([rows[:1], rows[:-1]])
            else:
                rows = np.vstack([last[None], rows])
                rows, shift = rows[1:], rows[:-1]
            own = (rows != shift).any(1)  # rows of a document that came twice count once
            own[0] |= last is None
            rows, shift = rows[own], shift[own]
            if not len(rows):
                continue
            new_run, new_doc = (rows[:, :2] != shift[:, :2]).any(1), (rows[:, :4] != shift[:, :4]).any(1)
            if not begun:  # a task's first run is at its edge
                new_run[0], new_doc[0], begun = False, True, True
            starts = np.flatnonzero(new_run)
            bounds = [0, *starts.tolist(), len(rows)] if not new_run[0] else [0, 0, *starts.tolist()[1:], len(rows)]
            # The open run: what it gains in this batch.
            part = rows[:bounds[1]]
            count += int(new_doc[:bounds[1]].sum())
            if edge:
                if len(part):
                    yield out(1, part)
            else:
                if held is not None:
                    part = np.vstack([held, part])
                if count >= min_docs:
                    if held is not None and first:
                        part = part[1:]
                    if len(part):
                        yield out(0, part)
                    held = None
                else:
                    held = part
            if len(bounds) > 2:  # the open run ends within this batch
                if edge:
                    yield total(last if not bounds[1] else rows[bounds[1] - 1], count, False)
                edge, held = False, None
                # Runs that lie in this batch whole.
                at = np.array(bounds[1:-1])
                docs_in = np.add.reduceat(new_doc.astype("i8"), at) if len(at) else np.zeros(0, "i8")
                lens = np.diff([*at, len(rows)])
                whole = np.arange(len(at)) < len(at) - 1
                drop = np.repeat(whole & (docs_in >= min_docs), lens)
                if first:
                    drop[at - at[0]] = False
                got = rows[at[0]:][drop]
                if len(got):
                    yield out(0, got)
                # The last one stays open.
                count = int(docs_in[-1])
                part = rows[at[-1]:]
                if count >= min_docs:
                    part = part[1:] if first else part
                    if len(part):
                        yield out(0, part)
                else:
                    held = part
            last = rows[-1]
        if begun:
            # The run at the end: rows that wait go to the totals, and its documents count there.
            if held is not None:
                yield out(1, held)
            yield total(last, count, not edge and held is None)

    return run


def dropped(found: DataFrame, min_docs: int, keep: str = "none") -> DataFrame:
    """doc, tx, pos of the lines to drop, from the rows of `lines`.

    Two runs a task at most come back as rows to settle: those that may go on in a neighbour.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    dealt = found.where("h1 is not null").repartitionByRange("h1", "h2", "doc", "tx").sortWithinPartitions("h1", "h2", "doc", "tx", "pos")
    got = cut(dealt.mapInArrow(_stream(min_docs, keep == "first"), OUT), "line-runs")
    # Two rows a task, so the totals are small whatever the data.
    totals = got.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("docs")).where(F.col("docs") >= min_docs)
    edge = got.where("kind = 1").join(F.broadcast(totals), ["h1", "h2"])
    if keep == "first":
        # The first row of a run that spans tasks: among edge rows, unless a task that held its start settled it.
        firsts = got.where("kind = 1").groupBy("h1", "h2").agg(F.min(F.struct("doc", "tx", "pos")).alias("least"))
        begun = got.where("kind = 2 and pos = 1").select("h1", "h2", F.lit(True).alias("begun"))
        edge = edge.join(F.broadcast(firsts), ["h1", "h2"]).join(F.broadcast(begun), ["h1", "h2"], "left").where(
            F.coalesce("begun", F.lit(False)) | (F.struct("doc", "tx", "pos") != F.col("least")))
    out = got.where("kind = 0").select("doc", "tx", "pos").unionByName(edge.select("doc", "tx", "pos"))
    out.tollgate_path = got.tollgate_path
    return out


def _bitmap():
    @F.pandas_udf("binary")
    def bits(n, at):
        import pandas as pd

        out = []
        for k, pos in zip(n, at):
            keep = np.ones(int(k), bool)
            keep[np.asarray(pos, "i8")] = False
            out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        return pd.Series(out)

    return bits


def unpack(data: bytes, n: int) -> np.ndarray:
    """A keep bitmap as n booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(data), "u1"), count=n).astype(bool)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1, id_col="doc_id", text_col="text") -> DataFrame:
    """doc, tx, n_lines, n_dropped, keep (zlib of packed bits): a row for each distinct document.

    Lines are what line feeds separate; a line's key is the line stripped of blanks, A-Z
    lowered. Keys of min_chars code points or more that min_docs documents or more hold lose
    all their lines, or all but the first by id and position (keep="first"; of one id, by the
    text's hash). Null and empty texts are one empty line, whose key is too short to drop.
    Rows that repeat id and text are one document; rows that repeat the id alone, and rows with
    a null id, are documents of their own by their texts. Texts may be of any length: a task
    holds one text's lines at a time. Other columns are not read. An empty table gives no rows.
    """
    found = cut(lines(docs, id_col, text_col, min_chars), "lines")
    gone = dropped(found, min_docs, keep)
    both = found.where("h1 is null").select("doc", "tx", F.col("pos").alias("n_lines"), F.lit(None).cast("int").alias("pos")).unionByName(
        gone.select("doc", "tx", F.lit(None).cast("int").alias("n_lines"), "pos"))
    got = both.groupBy("doc", "tx").agg(F.max("n_lines").alias("n_lines"), F.collect_list("pos").alias("at"))
    out = cut(got.select("doc", "tx", "n_lines", F.size("at").alias("n_dropped"), _bitmap()("n_lines", "at").alias("keep")), "bitmaps")
    drop_cut(found)
    drop_cut(gone)
    return out


def _kept(text: bytes, data: bytes | None, n: int) -> bytes:
    if data is None:
        return text
    parts = text.split(b"\n")
    return b"\n".join([x for x, k in zip(parts, unpack(data, n)) if k])


def _laid(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """Documents beside their bitmap (null where nothing is dropped)."""
    some = bitmaps.select("doc", "tx", "n_lines", "n_dropped", F.when(F.col("n_dropped") > 0, F.col("keep")).alias("keep"))
    return _keyed(docs, id_col, text_col, *more).join(some, ["doc", "tx"])


def apply(docs: DataFrame, bitmaps: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """docs with the kept lines alone, joined by line feeds. Null texts stay null; all columns stay."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*own)
    i, t = own[docs.columns.index(id_col)], own[docs.columns.index(text_col)]

    @F.pandas_udf("string")
    def cleared(text, keep, n):
        import pandas as pd

        return pd.Series([_kept(x, k, m).decode() for x, k, m in zip(text, keep, n)])

    got = _laid(d, bitmaps, i, t, F.struct(*own).alias("row"))
    new = F.when(F.col(f"row.{t}").isNotNull(), cleared("text", "keep", "n_lines"))
    return got.select(*[(new if c == t else F.col(f"row.{c}")).alias(c) for c in own]).toDF(*docs.columns)


def op11_line_dedup(spark, sf_dir):
    """doc_id, n_lines, n_dropped, kept_sha256; lines found in 10 documents or more go."""
    docs = table(spark, sf_dir, "documents")

    def digests(batches):
        for b in batches:
            kept = [hashlib.sha256(_kept(t, k, n)).hexdigest() for t, k, n in zip(b.column("text").to_pylist(), b.column("keep").to_pylist(), b.column("n_lines").to_pylist())]
            yield pa.record_batch([b.column("doc_id"), b.column("n_lines").cast("int64"), b.column("n_dropped").cast("int64"), pa.array(kept, "string")], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    got = _laid(docs, keep_bitmaps(docs, min_docs=10, min_chars=1), "doc_id", "text", F.col("doc_id").cast("long").alias("doc_id"))
    return got.select("doc_id", "text", "keep", "n_lines", "n_dropped").mapInArrow(digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLES = {"op11_line_dedup": """
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM parts),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key AS bad FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(bad) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bad IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN bad ON key = bad GROUP BY doc_id"""}
