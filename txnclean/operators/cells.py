"""Per-cell cleaning (B1-B6): one narrow pass of native projections.

``clean_cells`` turns raw string columns into cleaned output columns and two per-row
counters. It never shuffles; Spark fuses it into the scan's codegen stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.amounts import amount_stages
from ..functions.dates import date_stages
from ..functions.keys import amount_key, date_key, text_key
from ..functions.names import named
from ..functions.numbers import finite, number_text
from ..functions.text import clean_text
from ..plans.roles import ResolvedRoles

TMP = "__tc_"
DATE_FIXED = "__tc_date_fixed"
SYMBOLS = "__tc_symbols"
LIVE = "__tc_live"
BARRIER = "__tc_barrier"


def _as_string(df: DataFrame, c: str) -> Column:
    return number_text(named(c), df.schema[c].dataType) if c in df.columns else F.lit(None).cast("string")


def _is_number(df: DataFrame, c: str) -> bool:
    return c in df.columns and isinstance(df.schema[c].dataType, T.NumericType)


def clean_cells(df: DataFrame, roles: ResolvedRoles, ord_col: str = "_ord") -> DataFrame:
    """Return ``ord_col``, the cleaned output columns, ``DATE_FIXED``, ``SYMBOLS``, ``LIVE``.

    Raw cells are read as text (numbers in plain notation). Numeric columns in the amount
    role are never read as text: they pass through as double (NaN and infinities NULL).
    output columns absent from ``df`` are NULL (B2); ignored columns are NULL (B3).
    """
    outs = roles.output_columns
    raw = {c: f"{TMP}raw{i}" for i, c in enumerate(outs)}
    numbers = [c for c in outs if roles.role(c) == "amount" and _is_number(df, c)]
    base = df.select(F.col(ord_col), *[(finite(named(c)) if c in numbers else _as_string(df, c)).alias(raw[c]) for c in outs])

    stages: list[dict[str, Column]] = []
    fixed_cols, count_cols = [], []
    results: dict[str, str] = {}

    def merge(new_stages: list[dict[str, Column]]) -> None:
        for k, st in enumerate(new_stages):
            if k == len(stages):
                stages.append({})
            stages[k].update(st)

    for i, c in enumerate(outs):
        role = roles.role(c)
        res = f"{TMP}res{i}"
        results[c] = res
        if role == "date":
            fx = f"{TMP}fx{i}"
            merge(date_stages(raw[c], res, fx, f"{TMP}d{i}_"))
            fixed_cols.append(fx)
        elif c in numbers:
            results[c] = raw[c]
        elif role == "amount":
            cnt = f"{TMP}cnt{i}"
            merge(amount_stages(raw[c], res, cnt, f"{TMP}a{i}_"))
            count_cols.append(cnt)

    cur = base
    for st in stages:
        cur = cur.withColumns(st)

    def total(cols: list[str]) -> Column:
        return sum((F.col(x) for x in cols[1:]), F.col(cols[0])) if cols else F.lit(0)

    out_cols = []
    for c in outs:
        role = roles.role(c)
        if role in ("date", "amount"):
            out_cols.append(F.col(results[c]).alias(c))
        elif role == "text":
            out_cols.append(clean_text(F.col(raw[c])).alias(c))
        else:
            out_cols.append(F.lit(None).cast("string").alias(c))
    # ``LIVE`` (B6) is computed here from the stage outputs. ``BARRIER`` is a cheap
    # non-deterministic column: Catalyst does not push a filter through a projection
    # holding one, so a later filter on cleaned values (B6, user filters on the audit)
    # is not rewritten in terms of the raw text, which would inline every stage of
    # the date rule into one condition and overflow the 64 KB method limit.
    out = cur.select(F.col(ord_col), *out_cols,
                     total(fixed_cols).alias(DATE_FIXED), total(count_cols).alias(SYMBOLS),
                     F.spark_partition_id().alias(BARRIER))
    return out.withColumn(LIVE, non_empty(roles) & (F.col(BARRIER) >= 0))


def non_empty(roles: ResolvedRoles) -> Column:
    """At least one output column holds a value (0.0 counts as a value)."""
    cols = [c for c in roles.output_columns if roles.role(c) != "ignore"]
    if not cols:
        return F.lit(False)
    cond = named(cols[0]).isNotNull()
    for c in cols[1:]:
        cond = cond | named(c).isNotNull()
    return cond


def key_columns(roles: ResolvedRoles) -> list[Column]:
    """D1 key: one normalised part per output column (ignored columns are always '')."""
    parts = []
    for i, c in enumerate(roles.output_columns):
        role = roles.role(c)
        col = named(c)
        if role == "date":
            parts.append(date_key(col).alias(f"{TMP}k{i}"))
        elif role == "amount":
            parts.append(amount_key(col).alias(f"{TMP}k{i}"))
        elif role == "text":
            parts.append(text_key(col).alias(f"{TMP}k{i}"))
    return parts
