"""Text cell rules as native Column expressions.

Everything here is a ``Column -> Column`` function built from
``pyspark.sql.functions`` only, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` / ``str.split()`` treat as
# whitespace (``str.isspace``). Spark's ``trim`` only removes the ASCII space, so the
# class is spelled out for the JVM regex engine.
WS_CLASS = (
    r"[\t\n\x0B\f\r \x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
)

# The same characters as one literal string, for ``btrim`` (no regex per row).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")
# Whitespace other than the ASCII space (a run of these, or two spaces, needs collapsing).
WS_NOT_SPACE = WS_CHARS.replace(" ", "")

# Lower-cased, trimmed texts that mean "no value".
NULL_LIKE_TEXTS = ("", "nan", "na", "null", "none")


def trim_unicode(c: Column) -> Column:
    """Python ``str.strip()`` on a string column (``btrim`` over the whitespace set)."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    """Python ``" ".join(s.split())``: trim, then single spaces between words.

    The regex only runs on texts that hold a double space or non-space whitespace;
    that test is a character translation, not a regex."""
    t = trim_unicode(c)
    needs = (F.instr(t, "  ") > 0) | (F.length(F.translate(t, WS_NOT_SPACE, "")) != F.length(t))
    return F.when(needs, F.regexp_replace(t, f"{WS_CLASS}+", " ")).otherwise(t)


def is_null_like(c: Column) -> Column:
    """B1: NULL, or trimmed lower-case text in the null-like set. Never NULL itself."""
    return c.isNull() | F.lower(trim_unicode(c)).isin(*NULL_LIKE_TEXTS)


def clean_text(c: Column) -> Column:
    """B4 (after B1): trimmed text, case and inner spaces kept; null-like -> NULL."""
    return F.when(is_null_like(c), F.lit(None).cast("string")).otherwise(trim_unicode(c))


def text_key(c: Column) -> Column:
    """H1: dedupe key of a text cell: NULL -> '', collapse whitespace, lower-case."""
    return F.coalesce(F.lower(collapse_ws(c)), F.lit(""))
