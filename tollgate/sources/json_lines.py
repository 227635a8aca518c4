"""Attempts as lines of JSON that may be damaged: every line gives a row, with the reasons against it.

A line is read as a map of texts, so a field that is absent differs from one that is null, and a
value of another type spoils its own field alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.features import REQUIRED, entity_key, finite
from .attempts import RELATIONS

#: Fields of an attempt and the types that they are cast to; what can't be cast is null.
FIELDS = {"seq": "long", "ts_s": "double", "amount": "double", "approved": "boolean", "email_domain": "string", "device_id": "string", "ip_id": "string", "bin_id": "string", "card_id": "string", "score": "double"}
MALFORMED = "malformed record"


def _reasons(m: Column) -> Column:
    has = lambda f: F.map_contains_key(m, f)
    tests = [(~has(f), f"missing field {f}") for f in REQUIRED]
    tests += [(has(f) & ~finite(m[f]), f"{f} not finite") for f in ("ts_s", "amount")]
    tests.append((has("approved") & m["approved"].try_cast("boolean").isNull(), "approved is null"))
    tests.append((reduce(lambda a, b: a & b, [entity_key(m[r]).isNull() for r in RELATIONS]), "no usable entity"))
    return F.when(m.isNull(), F.array(F.lit(MALFORMED))).otherwise(F.array_compact(F.array(*[F.when(t, r) for t, r in tests])))


def parse(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns, FIELDS, reasons (empty if the row can be scored) and raw, a row for each line; null and empty lines are malformed. Batch or stream."""
    d = lines.select(*keep, F.col(column).alias("raw"), F.from_json(column, "map<string,string>").alias("m_"))
    return d.select(*keep, *[F.col("m_")[f].try_cast(t).alias(f) for f, t in FIELDS.items()], _reasons(F.col("m_")).alias("reasons"), "raw")


def counted(rows: DataFrame, name: str = "quarantine") -> DataFrame:
    """rows, with counts taken as they pass: seen, quarantined, and each reason's. A streaming query's progress
    shows them by batch under `name`; there is no second pass."""
    every = [MALFORMED, *[f"missing field {f}" for f in REQUIRED], "ts_s not finite", "amount not finite", "approved is null", "no usable entity"]
    return rows.observe(name, F.count(F.lit(1)).alias("seen"), F.count_if(F.size("reasons") > 0).alias("quarantined"), *[F.count_if(F.array_contains("reasons", r)).alias(r) for r in every])


def totals(progress, name: str = "quarantine") -> dict[str, int]:
    """The counts of several progress reports put together."""
    out: dict[str, int] = {}
    for p in progress:
        row = p.observedMetrics.get(name)
        for k, v in (row.asDict() if row is not None else {}).items():
            out[k] = out.get(k, 0) + v
    return out
