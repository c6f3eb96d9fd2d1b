"""Numeric input cells: values as they are, and their text as Python prints it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def float_text(x: Column) -> Column:
    """Text of a double: plain from 1e-4 up to 1e16, else ``1.5e+16``; ``inf``, ``-inf``, ``nan``."""
    s = x.cast("string")
    power = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    plain = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,21)").cast("string"), r"0+$", ""), r"\.$", ".0")
    digits = F.regexp_replace(F.regexp_extract(s, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    size = F.abs(power).cast("string")
    short = F.concat(digits, F.lit("e"), sign, F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size))
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), F.lit("nan"))
            .when(s == "Infinity", F.lit("inf"))
            .when(s == "-Infinity", F.lit("-inf"))
            .when(power.isNull(), s)
            .when((power >= -4) & (power < 16), plain)
            .otherwise(short))


def number_text(c: Column, kind: T.DataType) -> Column:
    """Text of a cell of any type; floating-point numbers never in the JVM's own notation."""
    if isinstance(kind, T.DoubleType):
        return float_text(c)
    if isinstance(kind, T.FloatType):
        return float_text(c.cast("string").cast("double"))
    return c.cast("string")


def finite(c: Column) -> Column:
    """The value as double; NaN and infinities are NULL (they hold no number to read)."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)
