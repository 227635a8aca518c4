"""License scan: phrases, and an exact set-similarity join of text blocks with templates.

A block is a line, or a window of words that crosses line ends, as long as the template's
text over the threshold (so hard-wrapped notices are compared whole). A template is matched by a block that holds at least `threshold` of its
distinct words. Words are ordered by how many documents hold them, counted over all
documents, rare first. A block must hold one of the first |T| - need + 1 words of a
template in that order (prefix filter), have at least `need` distinct words (length filter),
and, from its first match on in that order, have that many left (positional filter); only
what passes all three is intersected with the template and counted. The template side is a fixed list of literals, so nothing is
shuffled but the word counts (one row a word), and no key is hot.

Native throughout: DataFrame functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import table

# Letters, the characters of a word, phrases and their labels.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Short notices by the label that the join gives them.
TEMPLATES = {
    "notice:apache-2.0": "licensed under the apache license version 2.0",
    "notice:gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "notice:mit": "released under the mit license",
    "notice:cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "notice:mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "notice:bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "notice:mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "notice:reserved": "all rights reserved",
}
THRESHOLD = 0.8


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _template_words() -> dict[str, list[str]]:
    return {k: list(dict.fromkeys(re.findall(WORD, v))) for k, v in TEMPLATES.items()}


def lowered(text: Column) -> Column:
    """text with A-Z lowered and nothing else. Of a text of ASCII alone lower() does the same, in bytes; translate() looks up each character."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_order(docs: DataFrame, text_col="text") -> list[str]:
    """The templates' words, rarest first by the number of documents (over all of them) that hold each."""
    vocab = sorted({w for ws in _template_words().values() for w in ws})
    held = F.array_intersect(F.array(*map(F.lit, vocab)), F.regexp_extract_all(lowered(F.col(text_col)), F.lit(WORD), F.lit(0)))
    n = {r["w"]: r["n"] for r in docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocab, key=lambda w: (n.get(w, 0), w))  # as many rows as the templates have words


def block_scores(low: Column, order: list[str], threshold: float = THRESHOLD) -> Column:
    """Array of (label, containment) of the matches of blocks, for a lowered text.

    A block is as many words in a row as a template has, a quarter more at threshold 0.8, so a long
    line does not collect a template's words from afar. Lines no longer than that are blocks that go through the join's
    filters; windows of words cover longer lines and line ends.
    """
    rank = {w: i for i, w in enumerate(order)}
    plans = {}
    for label, ws in _template_words().items():
        ws = sorted(ws, key=rank.get)
        need = math.ceil(threshold * len(ws) - 1e-9)
        plans[label] = (ws, need)
    prefix = sorted({w for ws, need in plans.values() for w in ws[:len(ws) - need + 1]})
    least = min(need for _, need in plans.values())
    window = lambda label: math.ceil(len(re.findall(WORD, TEMPLATES[label])) / threshold - 1e-9)
    longest = max(map(window, plans))
    # Lines with a prefix word, before any is split into words.
    some = "(?<!" + WORD[:-1] + ")(?:" + "|".join(prefix) + ")(?!" + WORD[:-1] + ")"
    lines = F.filter(F.split(low, "\n"), lambda x: x.rlike(some))

    def scores(line: Column) -> Column:
        """A line's ordered words (those that no template has come first in the global order and match nothing, so they
        are left out), then per template the length, prefix and positional filters before any full intersection."""
        words = F.array_intersect(F.array(*map(F.lit, order)), F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))
        none = F.array().cast("array<struct<label:string,containment:double>>")
        every = lambda n: let(words, lambda held: F.filter(F.array(*[joined(held, n, label, *plan) for label, plan in plans.items()]), lambda x: x.isNotNull()))
        return let(words_in(line), lambda n: F.when((n >= least) & (n <= longest), every(n)).otherwise(none))

    def words_in(line: Column) -> Column:
        return F.regexp_count(line, F.lit(WORD))

    def joined(held: Column, n_words: Column, label: str, ws: list[str], need: int) -> Column:
        head = F.array(*map(F.lit, ws[:len(ws) - need + 1]))
        first = F.array_position(held, F.get(F.array_intersect(head, held), F.lit(0)))  # null without a prefix word
        fits = F.when((n_words <= window(label)) & (F.size(held) >= need), F.size(held) - first + 1 >= need)  # the rest of the block, from its first match on
        n = F.size(F.array_intersect(F.array(*map(F.lit, ws)), held))
        return F.when(fits, let(n, lambda n: F.when(n >= need, F.struct(F.lit(label).alias("label"), (n / F.lit(float(len(ws)))).alias("containment")))))

    def windows(words: Column) -> Column:
        """The best windows at prefix words; those within a short line give no more than the line does."""
        at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*prefix), i + 1)), lambda i: i.isNotNull())
        return let(at, lambda at: F.flatten(F.array(*[near(words, at, label, *plan) for label, plan in plans.items()])))

    def near(words: Column, at: Column, label: str, ws: list[str], need: int) -> Column:
        t = F.array(*map(F.lit, ws))
        size = window(label)
        start = lambda i: F.greatest(i - size + 1, F.lit(1))
        held = lambda a, n: F.size(F.array_intersect(t, F.slice(words, a, F.lit(n))))
        at = F.filter(at, lambda i: F.element_at(words, i).isin(*ws[:len(ws) - need + 1]) & (held(start(i), 2 * size - 1) >= need))
        best = F.transform(at, lambda i: F.array_max(F.transform(F.sequence(start(i), i), lambda a: held(a, size))))
        return F.transform(F.filter(best, lambda n: n >= need), lambda n: F.struct(F.lit(label).alias("label"), (n / F.lit(float(len(ws)))).alias("containment")))

    def both(lines: Column) -> Column:
        wrapped = F.when(F.size(lines) > 0, let(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), windows))
        found = F.flatten(F.transform(lines, scores))
        return F.concat(found, F.coalesce(wrapped, F.array().cast("array<struct<label:string,containment:double>>")))

    return let(lines, both)


def scan(docs: DataFrame, id_col="doc_id", text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words and no labels (empty strings) and score 0. Words are
    numbered from 0; texts may be of any length. score is the best containment of a template in a block, 1 where a base
    phrase stands. Repeated rows give repeated rows; a null id is kept.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = word_order(docs)
    low = F.col("low")
    edge = WORD[:-1]
    phrase = "|".join(p.replace(" ", GAP) for p in PHRASES)
    at = f"(?<!{edge})(?:{phrase})(?!{edge})"
    counted = lambda c: F.regexp_count(c, F.lit(WORD))
    d = docs.select("doc_id", lowered(F.col("text")).alias("low"))
    d = d.withColumn("found", F.when(low.rlike(at), F.regexp_extract_all(low, F.lit(at), F.lit(0))).otherwise(F.array().cast("array<string>")))
    # The parts between phrases; a phrase is a whole run of words, so counts add up.
    parts = F.when(F.size("found") > 0, F.split(low, at, -1))
    sizes = F.transform(F.col("found"), lambda x: counted(x).cast("long"))
    gaps = F.transform(parts, lambda x: counted(x).cast("long"))
    d = d.select("doc_id", counted(low).cast("long").alias("n_words"), F.size("found").cast("long").alias("n_base"), gaps.alias("gaps"), sizes.alias("sizes"),
                 F.array_sort(F.array_distinct(F.transform("found", lambda x: F.element_at(
                     F.create_map(*[F.lit(y) for p, v in PHRASES.items() for y in (p.split()[0], v)]), F.regexp_extract(x, WORD, 0))))).alias("base"),
                 block_scores(low, order, threshold).alias("hits"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    some = F.col("n_base") > 0
    return d.select(
        "doc_id", "n_words", "n_base",
        F.when(some, F.element_at("gaps", 1)).alias("first_word"),
        F.when(some, F.col("n_words") - F.element_at("gaps", -1) - F.element_at("sizes", -1)).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("hits", lambda x: x["label"])))), ",").alias("labels"),
        F.when(some, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("hits", lambda x: x["containment"])), F.lit(0.0))).alias("score"))


def op4_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES: dict = {}
