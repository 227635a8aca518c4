"""The corpus pipeline: quality, near duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns the columns of documents (the last: pieces of packed sequences).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tollgate.llm import decontaminate, neardup, packing, pii, quality
from tollgate.llm.common import cut, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: No stage is a relational query, so there is no SQL of the whole; tests hold each stage against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of this input, predicts to be good."""
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    name = "score_" + "_" * max(len(c) for c in docs.columns)
    return quality.score(docs, model, keep=tuple(docs.columns), out_col=name).where(F.col(name) >= 0.5).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (word 5-grams, similarity 0.8): its smallest id.

    Rows that repeat an id are of one group by that, whatever their texts; the row of the
    smallest text stays (of equal texts the smallest row as JSON). Rows with a null id stay.
    """
    groups = neardup.groups(docs, n=5, percent=80)
    # Ids that go, or whose rows are looked at, are far fewer than those that stay, so this side of the join is the small one.
    some = cut(groups.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1"), "kept")
    out = docs.join(some.select("doc_id").hint("merge"), "doc_id", "left_anti")  # rows with a null id match nothing
    if not (many := some.where("kept").select("doc_id")).isEmpty():
        row = F.struct(*docs.columns)
        one = docs.join(many.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out.select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    name = "leaks_" + "_" * max(len(c) for c in docs.columns)
    return decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), out=name).where(F.size(name) == 0).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text."""
    own = [f"c{i}" for i in range(len(docs.columns))]  # names that clash with none of the operator's
    at = own[docs.columns.index("text")]
    got = pii.scrub(docs.toDF(*own), pii.session_key(spark), at).select(*own).toDF(*docs.columns)
    return got.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else got


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    got = packing.pieces(docs, public_tokenizers.path(TOKENIZER), END_ID)
    return packing.pack(got.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicates_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
