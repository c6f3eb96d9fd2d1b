"""Date cell rules (F1-F11) as staged native projections.

The whole rule written as one nested expression grows past the 64 KB limit of a
generated Java method, so it is split into stages; each stage is one ``select``
whose intermediate columns are used more than once, which keeps Catalyst from
collapsing the stages back together. No Python runs per row.

Public entry: :func:`date_stages` returns the stages for one source column; the
cleaning operator runs the stages of all date columns side by side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NULL_LIKE_TEXTS, WS_CLASS, trim_unicode

# Token patterns, tried in this order (first one found wins).
ISO_TOKEN = r"(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})"
NUMERIC_TOKEN = r"(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})"
MONTH_TOKEN = r"(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}|\b[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}\b)"
CANONICAL = r"^\d{4}-\d{2}-\d{2}$"
# The reference searches whitespace-collapsed text. Searching the trimmed text with
# every whitespace run accepted where a single space would be finds the same tokens,
# so the month pattern takes the full whitespace class and no collapse pass is needed.
MONTH_TOKEN_RAW = MONTH_TOKEN.replace(r"\s+", WS_CLASS + "+")
SEPARATORS = r"[-/.]"

# English month names, short and full, in calendar order.
MONTHS_SHORT = ("jan", "feb", "mar", "apr", "may", "jun",
                "jul", "aug", "sep", "oct", "nov", "dec")
MONTHS_FULL = ("january", "february", "march", "april", "may", "june", "july",
               "august", "september", "october", "november", "december")


def _month_map() -> Column:
    number = {}
    for names in (MONTHS_SHORT, MONTHS_FULL):
        for i, name in enumerate(names):
            number[name] = i + 1  # "may" is both short and full
    return F.create_map(*[x for name, i in number.items() for x in (F.lit(name), F.lit(i))])


def _int(c: Column) -> Column:
    return c.try_cast("int")


def date_stages(src: str, out: str, fixed_out: str, tmp: str) -> list[dict[str, Column]]:
    """Stages turning raw text column ``src`` into ISO text ``out`` plus a 0/1 ``fixed_out``.

    Each token regex runs only when the earlier forms found nothing; token parts come
    from one ``split``. ``tmp`` prefixes the intermediate columns.
    """
    t, nl, canon = f"{tmp}t", f"{tmp}nl", f"{tmp}canon"
    iso, num, mon, kind, parts = f"{tmp}iso", f"{tmp}num", f"{tmp}mon", f"{tmp}kind", f"{tmp}parts"
    y, m, d, val, iso_text = f"{tmp}y", f"{tmp}m", f"{tmp}d", f"{tmp}val", f"{tmp}isot"
    p1, p2, p3 = f"{tmp}p1", f"{tmp}p2", f"{tmp}p3"
    col = F.col
    empty = F.lit("")

    stage1 = {t: trim_unicode(col(src))}
    stage2 = {
        nl: col(t).isNull() | F.lower(col(t)).isin(*NULL_LIKE_TEXTS),
        canon: (F.length(col(t)) == 10) & col(t).rlike(CANONICAL),
        iso: F.regexp_extract(col(t), ISO_TOKEN, 1),          # F3
    }
    stage3 = {num: F.when(col(iso) == "", F.regexp_extract(col(t), NUMERIC_TOKEN, 1)).otherwise(empty)}
    stage4 = {mon: F.when((col(iso) == "") & (col(num) == ""),
                          F.regexp_extract(col(t), MONTH_TOKEN_RAW, 1)).otherwise(empty)}
    stage5 = {
        kind: (F.when(col(iso) != "", 1).when(col(num) != "", 2)
               .when(col(mon) != "", 3).otherwise(0)),
        # comma -> space, single spaces; then the three parts of any token form.
        parts: (F.when(col(iso) != "", F.split(col(iso), SEPARATORS))
                .when(col(num) != "", F.split(col(num), SEPARATORS))
                .when(col(mon) != "", F.split(F.trim(F.regexp_replace(col(mon), f"[,{WS_CLASS[1:-1]}]+", " ")), " "))),
    }
    stage6 = {p1: F.element_at(col(parts), 1), p2: F.element_at(col(parts), 2),
              p3: F.element_at(col(parts), 3)}
    a1, a2, a3 = _int(col(p1)), _int(col(p2)), _int(col(p3))
    swap = (a2 > 12) & (a1 <= 12)                             # F7
    day_first = a1.isNotNull()                                # "16 Apr 2026" vs "Apr 16 2026"
    mmap = _month_map()
    stage7 = {
        y: (F.when(col(kind) == 1, a1)
            .when(col(kind) == 2, F.when(a3 < 100, a3 + 2000).otherwise(a3))   # F8
            .when(col(kind) == 3, F.when(F.length(col(p3)) == 4, a3))),       # 4-digit year only
        m: (F.when(col(kind) == 1, a2)
            .when(col(kind) == 2, F.when(swap, a1).otherwise(a2))
            .when(col(kind) == 3, F.element_at(mmap, F.lower(F.when(day_first, col(p2)).otherwise(col(p1)))))),
        d: (F.when(col(kind) == 1, a3)
            .when(col(kind) == 2, F.when(swap, a2).otherwise(a1))
            .when(col(kind) == 3, F.when(day_first, a1).otherwise(a2))),
    }
    # ISO text, kept only when it names a real calendar day (years 1-9999).
    stage8 = {iso_text: F.when(
        col(y).between(1, 9999) & col(m).isNotNull() & col(d).isNotNull(),
        F.concat(F.lpad(col(y).cast("string"), 4, "0"), F.lit("-"),
                 F.lpad(col(m).cast("string"), 2, "0"), F.lit("-"),
                 F.lpad(col(d).cast("string"), 2, "0")))}
    stage9 = {val: F.when(col(iso_text).try_cast("date").isNotNull(), col(iso_text))}
    stage10 = {
        out: (F.when(col(nl), F.lit(None).cast("string"))
              .when(col(canon), col(t))
              .otherwise(col(val))),
        fixed_out: F.when(~col(nl) & ~col(canon) & col(val).isNotNull(), 1).otherwise(0),
    }
    return [stage1, stage2, stage3, stage4, stage5, stage6, stage7, stage8, stage9, stage10]
