"""Text similarity for ghost tests (C4): the one rule Spark has no native form for.

``ratio_udf`` is an Arrow-batched pandas UDF around the standard library's
``difflib.SequenceMatcher`` (Ratcliff/Obershelp, default autojunk), called with the
*later* row's text first because the ratio is asymmetric. It only ever sees
candidate pairs that passed the exact native prefilters.

``text_tokens`` and ``prefix_of`` support exact blocking with built-in functions: a ratio
of at least ``t`` implies a character-multiset overlap of at least ``t*len/(2-t)``, so two
such texts share a token in the first ``len - ceil(t*len/(2-t)) + 1`` tokens under any
fixed global token order (prefix filtering). Tokens are (character, occurrence) pairs as
longs; ``overlap`` of two token arrays is the multiset overlap itself.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order of characters in prefixes: any others first, then digits, then letters from rare to
#: frequent in European text, the blank last. The order decides the cost alone, never the result.
COMMON_CHARACTERS = "0123456789zqxjkvbpygfwmucldrhsnioate "


@F.pandas_udf(T.DoubleType())
def ratio_udf(later: pd.Series, earlier: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(later, earlier)],
                     dtype="float64")


def _rows_of(codes: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The codes of some texts as a table, -1 after a text's end."""
    first = np.cumsum(size) - size
    n = size[rows]
    out = np.full((len(rows), int(n.max()) if len(rows) else 0), -1, np.int64)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(rows)), n), at] = codes[np.repeat(first[rows], n) + at]
    return out


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of two tables of codes (0 to 63, up to 64 a row, -1: none),
    bit-parallel. Matched blocks of a ratio are a common subsequence."""
    every = np.arange(len(a))
    where = np.zeros((len(a), 64), np.uint64)
    for p in range(a.shape[1]):
        on = np.flatnonzero(a[:, p] >= 0)
        where[on, a[on, p]] |= np.uint64(1) << np.uint64(p)
    v = np.full(len(a), ~np.uint64(0))
    for p in range(b.shape[1]):
        u = v & np.where(b[:, p] >= 0, where[every, b[:, p]], np.uint64(0))
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def similar_udf(threshold: float):
    """Whether ``ratio_udf`` reaches a threshold: the characters that two texts have in common, and then those in
    common in the same order (by the last six bits of their code points, a whole batch at once), are upper bounds;
    few pairs need the ratio itself. Of two texts of which one holds the other, all of the shorter is matched."""
    @F.pandas_udf(T.BooleanType())
    def similar(later: pd.Series, earlier: pd.Series) -> pd.Series:
        both = [np.zeros((len(later), 64), np.int64)] * 2
        sizes, codes = [None, None], [None, None]
        for k, texts in enumerate((later, earlier)):
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            sizes[k], codes[k] = size, points & 63
            cells = np.repeat(np.arange(len(texts)), size) * 64 + codes[k]
            both[k] = np.bincount(cells, minlength=64 * len(texts)).reshape(-1, 64)
        total = both[0].sum(1) + both[1].sum(1)
        may = 2.0 * np.minimum(both[0], both[1]).sum(1) >= threshold * total - 1e-9
        short = np.flatnonzero(may & (sizes[0] <= 64) & (sizes[1] <= 64))
        may[short] = 2.0 * in_order(*(_rows_of(codes[k], sizes[k], short) for k in (0, 1))) >= threshold * total[short] - 1e-9
        out = np.zeros(len(later), bool)
        for i in np.flatnonzero(may):
            a, b = later.iloc[i], earlier.iloc[i]
            if len(b) < 200 and (a in b or b in a):      # (longer ones: difflib leaves out frequent characters)
                out[i] = (2.0 * min(len(a), len(b)) / (len(a) + len(b)) if a or b else 1.0) >= threshold
            else:
                out[i] = SequenceMatcher(None, a, b).ratio() >= threshold
        return pd.Series(out)
    return similar


def text_tokens(text: Column) -> Column:
    """All (character, occurrence) tokens of a text in the global order, as distinct longs.

    Rank, code point and occurrence sit in separate bit ranges, so equal tokens are equal
    numbers and the ascending order of numbers is the global order."""
    chars = F.array_sort(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (
        F.shiftleft(F.instr(F.lit(COMMON_CHARACTERS), c).cast("long") * F.lit(1 << 21).cast("long") + F.ascii(c).cast("long"), 32))))
    return F.transform(chars, lambda v, k: v + k - F.array_position(chars, v) + 1)


def prefix_of(tokens: Column, threshold: float) -> Column:
    """The prefix tokens at ratio ``threshold`` (0 < t <= 1); all empty texts share the token 0."""
    n = F.size(tokens)
    need = F.ceil(n * F.lit(threshold / (2.0 - threshold)) - F.lit(1e-9))
    first = F.slice(tokens, F.lit(1), F.greatest(F.lit(1), F.least(n, n - need + 1)).cast("int"))
    return F.when(n == 0, F.array(F.lit(0).cast("long"))).otherwise(first)


def overlap(tokens: str, others: str) -> Column:
    """Characters that two texts have in common, by their full token arrays."""
    return F.size(F.array_intersect(tokens, others))
