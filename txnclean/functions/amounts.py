"""Amount cell rules (G1-G7) as staged native projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NULL_LIKE_TEXTS, trim_unicode

# The currency symbols that are counted and removed.
CURRENCY_SYMBOLS = "$€£¥₹₩₺₫₽₪₴₦₲₵₱"

# The first unsigned number in the remaining text.
NUMBER = r"(\d+(\.\d+)?)"


def symbol_count(c: Column) -> Column:
    """How many currency symbols occur in the text (0 for NULL)."""
    stripped = F.translate(c, CURRENCY_SYMBOLS, "")
    return F.coalesce(F.length(c) - F.length(stripped), F.lit(0))


def amount_stages(src: str, out: str, count_out: str, tmp: str) -> list[dict[str, Column]]:
    """Stages turning raw text ``src`` into a double ``out`` and a symbol count ``count_out``."""
    t, nl, s1, neg1, s2 = f"{tmp}t", f"{tmp}nl", f"{tmp}s1", f"{tmp}neg1", f"{tmp}s2"
    col = F.col
    stage1 = {t: trim_unicode(col(src))}
    # Accounting negative "(...)"; the inner text is trimmed again.
    stage2 = {
        nl: col(t).isNull() | F.lower(col(t)).isin(*NULL_LIKE_TEXTS),
        neg1: col(t).startswith("(") & col(t).endswith(")"),
    }
    stage3 = {
        s1: trim_unicode(F.when(col(neg1), F.expr(f"substr(`{t}`, 2, length(`{t}`) - 2)"))
                         .otherwise(col(t))),
    }
    # A leading minus is read before the symbols are removed.
    neg = col(neg1) | col(s1).startswith("-")
    body = F.when(col(s1).startswith("-"), F.expr(f"substr(`{s1}`, 2)")).otherwise(col(s1))
    # Drop symbols, commas and ASCII spaces; G6: first number -> double.
    cleaned = F.translate(body, CURRENCY_SYMBOLS + ", ", "")
    value = F.regexp_extract(cleaned, NUMBER, 1).try_cast("double")
    stage4 = {s2: F.when(neg, -value).otherwise(value)}
    stage5 = {
        out: F.when(col(nl), F.lit(None).cast("double")).otherwise(col(s2)),
        count_out: F.when(col(nl), F.lit(0)).otherwise(symbol_count(col(t))),
    }
    return [stage1, stage2, stage3, stage4, stage5]
