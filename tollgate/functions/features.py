"""Scalar functions: null markers, finiteness, quarantine reasons, model features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.attempts import RELATIONS

# Spellings of an absent identifier.
ABSENT = ("", "none", "nan", "null", "na", "n/a", "unknown", "unk", "-")
# Free mail domains (the first two count for the network), and required columns.
FREE_MAIL = ("gmail.com", "outlook.com", "yahoo.com")
REQUIRED = ("ts_s", "amount", "approved", "email_domain", "device_id", "ip_id", "bin_id")


def entity_key(c: Column) -> Column:
    """The identifier without white space around it; null if it only marks absence."""
    s = F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.when(F.lower(s).isin(*ABSENT), None).otherwise(s)


def link_key(df: DataFrame, name: str) -> Column:
    """An identifier column as rows may be linked by it: text without markers of absence, numbers as text."""
    c = F.col(name)
    return entity_key(c) if df.schema[name].dataType.typeName() == "string" else c.cast("string")


def finite(c: Column) -> Column:
    x = c.try_cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def reasons(df: DataFrame) -> Column:
    """Why a row can't be scored; an empty array if it can."""
    tests = [(F.lit(c not in df.columns), f"missing field {c}") for c in REQUIRED]
    tests += [(~finite(F.col(c)), f"{c} not finite") for c in ("ts_s", "amount") if c in df.columns]
    if "approved" in df.columns:
        tests.append((F.col("approved").isNull(), "approved is null"))
    have = [entity_key(F.col(r)).isNull() for r in RELATIONS if r in df.columns]
    tests.append((reduce(lambda a, b: a & b, have, F.lit(True)), "no usable entity"))
    return F.array_compact(F.array(*[F.when(t, r) for t, r in tests]))


def hour(ts: Column) -> Column:
    return F.pmod(F.floor(ts / 3600), F.lit(24))


def node_features(df: DataFrame, use_approved: bool = True, domains=FREE_MAIL[:2], keep: tuple[str, ...] = ()) -> DataFrame:
    """Features of the network; keep names columns to carry along, so that a stream needs no join."""
    return df.select("seq", *keep, F.log1p("amount").alias("f_log_amount"), (F.col("amount") < 25).cast("double").alias("f_small"),
                     (F.col("approved").cast("double") if use_approved else F.lit(0.0)).alias("f_approved"), (hour(F.col("ts_s")) / F.lit(24.0)).alias("f_hour"),
                     F.col("email_domain").isin(*domains).cast("double").alias("f_free_mail"), F.lit(1.0).alias("f_one"))


def transaction_features(df: DataFrame, domains=FREE_MAIL) -> DataFrame:
    return df.select("seq", F.col("amount"), F.log1p("amount").alias("log_amount"), hour(F.col("ts_s")).cast("double").alias("hour"),
                     F.col("approved").cast("double").alias("approved"), (F.col("amount") < 25).cast("double").alias("small"), F.col("email_domain").isin(*domains).cast("double").alias("free_mail"))
