"""Dedupe keys, output formatting and value tests (H1-H6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_key, trim_unicode

# The ISO date text test used at load time.
ISO_DATE_TEXT = r"^\d{4}-\d{2}-\d{2}$"

# The grammar of Python's float() (after strip): digits with single
# underscores between them, optional fraction and exponent, or inf/infinity/nan.
_DIGITS = r"\d(_?\d)*"
PY_FLOAT_TEXT = (
    rf"^[+-]?(({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?"
    r"|(?i:inf|infinity|nan))$"
)


def round_two(x: Column) -> Column:
    """A double rounded to two places by its exact binary value (half-even only where that is a half).

    ``bround`` goes by the shortest decimal text, which differs only where that text ends in a 5 at the third
    place: x is the double next to n / 1000. There, 1000 x is taken as the sum of two doubles without
    error (x is split in halves of 26 bits, and 1000 has 10), and its distance from n tells the side."""
    p = x * F.lit(1000.0)
    n = F.rint(p)
    wide = x * F.lit(134217729.0)                    # 2^27 + 1 splits a double
    high = wide - (wide - x)
    error = (high * F.lit(1000.0) - p) + (x - high) * F.lit(1000.0)
    side = (p - n) + error
    tie = (F.abs(x) < F.lit(1e13)) & (F.abs(n % F.lit(10.0)) == F.lit(5.0)) & (n / F.lit(1000.0) == x)
    moved = (n + F.when(side > 0, F.lit(5.0)).otherwise(F.lit(-5.0))) / F.lit(10.0) / F.lit(100.0)
    return F.when(tie & (side != 0), moved).otherwise(F.bround(x, 2))


def two_places(x: Column) -> Column:
    """``f"{round(x, 2):.2f}"`` for a double: rounded by the exact value, sign of zero kept.

    The text comes from a ``decimal(38,2)`` cast (no per-row formatter); values too
    large for it fall back to ``format_string``."""
    r = round_two(x)
    negative = (x < 0) | F.startswith(x.cast("string"), F.lit("-"))
    as_dec = r.try_cast("decimal(38,2)").cast("string")
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(r == 0, F.when(negative, F.lit("-0.00")).otherwise(F.lit("0.00")))
            .when(as_dec.isNotNull(), as_dec)
            .otherwise(F.format_string("%.2f", r)))


def amount_key(x: Column) -> Column:
    """H2: NULL -> '', else the value to two places."""
    return F.coalesce(two_places(x), F.lit(""))


def date_key(c: Column) -> Column:
    """H3: NULL -> '', else trimmed text."""
    return F.coalesce(trim_unicode(c), F.lit(""))


def amount_text(x: Column) -> Column:
    """H4: two places with trailing zeros and the dot removed (1200.0 -> '1200')."""
    return F.regexp_replace(two_places(x), r"\.?0+$", "")


def is_iso_date_text(c: Column) -> Column:
    """H5: pattern test only (2026-02-31 passes)."""
    return c.rlike(ISO_DATE_TEXT)


def is_float_text(c: Column) -> Column:
    """H6: would Python's float() accept the (stripped) text."""
    return trim_unicode(c).rlike(PY_FLOAT_TEXT)


def float_from_text(c: Column) -> Column:
    """Value of a text that passed :func:`is_float_text`, read like Python's float()."""
    t = F.lower(F.regexp_replace(trim_unicode(c), "_", ""))
    special = (F.when(t.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
               .when(t.isin("-inf", "-infinity"), F.lit(float("-inf")))
               .when(t.isin("nan", "+nan", "-nan"), F.lit(float("nan"))))
    return F.coalesce(special, t.try_cast("double"))


__all__ = ["text_key", "amount_key", "date_key", "amount_text", "two_places",
           "is_iso_date_text", "is_float_text", "float_from_text"]
