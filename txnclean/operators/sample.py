"""Prefix sample and SQL type inference.

E3: per column, the first (up to) 20 non-blank values, reading rows in arrival order
only until *every* column has at least one value. In Spark: one aggregate gives each
column's first non-blank ``_ord``; their maximum ``L`` bounds the prefix; rows with
``_ord <= L`` are unpivoted and ``row_number() <= 20`` per column (a window group
limit) keeps the sample. A column that is never filled makes the prefix the whole
table, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import named
from ..functions.keys import is_float_text, is_iso_date_text
from ..functions.text import is_null_like, trim_unicode

ORD = "_ord"
SAMPLE_SIZE = 20
# Name keywords for FLOAT columns (no debit/credit here).
AMOUNT_KEYWORDS = ("amount", "amt", "value", "total", "price", "expense", "income", "balance")


def non_blank(c: Column) -> Column:
    return c.isNotNull() & (trim_unicode(c) != "")


def profile(df: DataFrame, columns: list[str]) -> dict:
    """One pass: row count, first non-blank ``_ord`` per column, and per column the
    number of non-null-like values Python's float() would reject / that are not dates."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        col = named(c)
        present = ~is_null_like(col)
        t = trim_unicode(col)
        aggs += [
            F.min(F.when(non_blank(col), F.col(ORD))).alias(f"first{i}"),
            F.count(F.when(present & ~is_float_text(col), 1)).alias(f"badf{i}"),
            F.count(F.when(present & ~(is_iso_date_text(t) & t.try_cast("date").isNotNull()), 1))
            .alias(f"badd{i}"),
        ]
    row = df.agg(*aggs).collect()[0]
    return {
        "rows": row["__rows"],
        "first": [row[f"first{i}"] for i in range(len(columns))],
        "bad_float": [row[f"badf{i}"] for i in range(len(columns))],
        "bad_date": [row[f"badd{i}"] for i in range(len(columns))],
    }


def sample(df: DataFrame, columns: list[str], prefix_end) -> DataFrame:
    """``(column, pos, value)`` for the first 20 non-blank values per column."""
    pre = (df if prefix_end is None
           else df.where(F.col(ORD) <= prefix_end.cast(df.schema[ORD].dataType)))
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string")
    stacked = pre.select(ORD, F.explode(F.array(*[
        F.struct(F.lit(i).alias("idx"), F.lit(c).alias("column"), named(c).alias("value"))
        for i, c in enumerate(columns)])).alias("s")).select(ORD, "s.*")
    stacked = stacked.where(non_blank(F.col("value")))
    rn = F.row_number().over(Window.partitionBy("idx").orderBy(ORD))
    return (stacked.withColumn("rn", rn).where(F.col("rn") <= SAMPLE_SIZE)
            .select("column", trim_unicode(F.col("value")).alias("value")))


def _ord_literal(v) -> Column:
    if v is None:
        return None
    if hasattr(v, "asDict"):
        return F.struct(*[_ord_literal(x).alias(k) for k, x in v.asDict().items()])
    return F.lit(v)


def infer_sql_types(df: DataFrame, columns: list[str], prof: dict | None = None) -> dict[str, str]:
    """DATE / FLOAT / VARCHAR per column from the E3 sample."""
    prof = prof or profile(df, columns)
    firsts = prof["first"]
    prefix_end = None
    if columns and all(f is not None for f in firsts):
        prefix_end = _ord_literal(max(firsts))
    smp = sample(df, columns, prefix_end)
    stats = {r["column"]: r for r in smp.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(is_iso_date_text(F.col("value"))).alias("all_date"),
        F.bool_and(is_float_text(F.col("value"))).alias("all_float")).collect()}
    types = {}
    for c in columns:
        s = stats.get(c)
        if s is not None and s["n"] > 0 and "date" in c.lower() and s["all_date"]:
            types[c] = "DATE"
        elif (s is not None and s["n"] > 0 and any(k in c.lower() for k in AMOUNT_KEYWORDS)
              and s["all_float"]):
            types[c] = "FLOAT"
        else:
            types[c] = "VARCHAR"
    return types
