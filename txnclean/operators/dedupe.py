"""First-row-wins exact dedupe (D1, D2) that does not depend on partitioning.

One ``groupBy`` on the normalised key with ``min_by(row, _ord)``: Spark runs a
partial aggregate before the shuffle, so a hot key (even a third of all rows)
collapses to one row per map task before anything moves, and which row survives is
decided by the explicit order column, never by task or partition order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import named, quote_name

GROUP_SIZE = "__tc_n"
ROW = "__tc_row"


def first_per_key(df: DataFrame, keys: list[Column], ord_col: str,
                  extra_aggs: list[Column] | None = None) -> DataFrame:
    """One row per distinct key: the row with the smallest ``ord_col``.

    Returns the key columns, every input column of that first row, ``GROUP_SIZE``
    (rows sharing the key) and any ``extra_aggs``.
    """
    value_cols = df.columns
    keyed = df.select(*keys, *[named(c) for c in value_cols])
    key_names = keyed.columns[: len(keys)]
    grouped = keyed.groupBy(*[F.col(k) for k in key_names]).agg(
        F.min_by(F.struct(*[named(c) for c in value_cols]), F.col(ord_col)).alias(ROW),
        F.count(F.lit(1)).alias(GROUP_SIZE),
        *(extra_aggs or []),
    )
    extra_names = [c for c in grouped.columns if c not in key_names + [ROW, GROUP_SIZE]]
    return grouped.select(
        *key_names, *[F.col(f"{ROW}.{quote_name(c)}").alias(c) for c in value_cols], GROUP_SIZE, *extra_names)


def dedupe_first_wins(df: DataFrame, keys: list[Column], ord_col: str = "_ord") -> DataFrame:
    """Keep the first row (by ``ord_col``) of every key; drop the key columns."""
    out = first_per_key(df, keys, ord_col)
    return out.select(*[named(c) for c in df.columns])
