"""Segments of texts: exact blocking for a similarity ratio above one half.

A ratio of at least t leaves at most k = (1 - t)(la + lb) characters of two texts unmatched. Each of them
breaks at most one of several disjoint segments of the longer text, so of any k + 1 segments one
occurs whole in the other text; what is unmatched before and after it bounds how far it is shifted.
The longer text is therefore indexed by k + 1 segments of a grid, those that are rarest in all texts, and the
shorter one asks with its substrings. Words of a common template are not among the rarest segments.
Where the grid has others about as rare, up to EXTRA more are indexed, and as many more must occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Longest segment.
LONGEST = 4
#: So many of the most frequent segments are known to all tasks (12 bytes each); others count as rare. It
#: decides which segments are indexed, never the result.
KNOWN = 1 << 16
#: Segments, about as rare, indexed beyond those that a similar text can lack and one.
EXTRA = 2
#: A segment is frequent from so many texts on.
FREQUENT = 8
#: Index and probe rows that are joined at a time, and the most parts that they are joined in (the disk that they take; never the result).
ROWS, PARTS = 1 << 26, 8
#: Segments that a task counts at a time; of more, the frequent half goes on (this too decides costs alone).
COUNTED = 1 << 18

_M = np.uint64(0x9FB21C651E98DF25)


def broken(threshold: float, longer: int) -> int:
    """The most segments of a text of this length that a similar text, no longer than it, can lack."""
    return int(2 * (1 - threshold) * longer + 1e-9)


def widths(threshold: float, n: int) -> list[int]:
    """Lengths of segments that a text of n characters may be indexed by."""
    q = min(LONGEST, n // (broken(threshold, n) + 1))
    return [w for w in (q, q - 1) if w >= 1]


def asked(threshold: float, n: int) -> list[int]:
    """Lengths of the segments that texts of n or more characters, similar to one of n, may be indexed by."""
    longest = int(n * (2 - threshold) / threshold + 1e-9)
    return sorted({w for m in range(n, longest + 1) for w in widths(threshold, m)})


Frequent = tuple[np.ndarray, np.ndarray, np.ndarray]


class Grams:
    """Hashes of the substrings of a batch of texts."""

    def __init__(self, texts: list[str]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.hashes = [np.zeros(0, np.uint64)]
        h = np.zeros(len(points), np.uint64)
        for w in range(1, LONGEST + 1):
            h = h * _M
            h[:len(h) - w + 1] += points[w - 1:] + np.uint64(1)
            x = (h + np.uint64(w)) * np.uint64(0xD6E8FEB86659FD93)
            self.hashes.append((x ^ (x >> np.uint64(32))).view(np.int64))
        self.owner = np.repeat(np.arange(len(texts)), self.size)
        # two bits for each of 32 kinds of characters: their number modulo four, in an order in which one more or less
        # turns one bit; so each unmatched character turns one bit
        code = points.astype(np.int64)
        kind = (code + np.where(code < 64, 11, 0)) & 31       # digits apart from most letters
        number = np.bincount(self.owner * 32 + kind, minlength=32 * len(texts)).reshape(-1, 32) & 3
        self.parity = ((number ^ (number >> 1)).astype(np.uint64) << (2 * np.arange(32, dtype=np.uint64))).sum(1, dtype=np.uint64).view(np.int64)

    def of(self, i: int, w: int, step: int = 1) -> np.ndarray:
        """Hashes of text i's substrings of length w, from each ``step``-th character on."""
        a = int(self.first[i])
        return self.hashes[w][a:a + int(self.size[i]) - w + 1:step]

    def places(self, w: int, asks) -> np.ndarray:
        """Where in ``hashes[w]`` are the substrings of length w of those texts whose length ``asks`` for them."""
        length, which = np.unique(self.size, return_inverse=True)
        on = np.array([bool(n) and w in asks(n) for n in length.tolist()], bool)[which]
        left = self.first[1:][self.owner] - np.arange(len(self.owner))
        return np.flatnonzero(on[self.owner] & (left >= w))


def _asked_widths(threshold: float, used: dict[int, list[int]] | None = None):
    known: dict[int, list[int]] = {}

    def of(n: int) -> list[int]:
        if n not in known:
            longest = int(n * (2 - threshold) / threshold + 1e-9)
            known[n] = asked(threshold, n) if used is None else sorted({w for m, ws in used.items() if n <= m <= longest for w in ws})
        return known[n]
    return of


def frequent_segments(texts: DataFrame, text_col: str, threshold: float) -> Frequent:
    """(hashes in order, number of texts) of the KNOWN most frequent segments, a bounded table, and by width about how
    many texts one of the others is in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _asked_widths(threshold)
        held = {w: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for w in range(1, LONGEST + 1)}
        for b in batches:
            grams = Grams(b.column(0).to_pylist())
            for w in range(1, LONGEST + 1):
                at = grams.places(w, of)
                if not len(at):
                    continue
                gram, n = held[w]
                more = grams.hashes[w][at]
                order = np.argsort(more, kind="stable")     # (equal ones stay in the order of their texts)
                more, text = more[order], grams.owner[at][order]
                more = more[np.concatenate([[True], (more[1:] != more[:-1]) | (text[1:] != text[:-1])])]
                gram, at = np.unique(np.concatenate([gram, more]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, np.ones(len(more), np.int64)]), len(gram)).astype(np.int64)
                if len(gram) > COUNTED:
                    top = np.sort(np.argpartition(-n, COUNTED // 2)[:COUNTED // 2])
                    gram, n = gram[top], n[top]
                held[w] = gram, n
        for w, (gram, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), w, np.int32)), pa.array(gram), pa.array(n)], names=["w", "gram", "n"])

    counts = cut_lineage(texts.select(text_col).mapInArrow(run, "w int, gram long, n long").groupBy("w", "gram").agg(F.sum("n").alias("n")))
    top = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "gram").limit(KNOWN).collect()
    other = np.ones(LONGEST + 1)
    for r in counts.groupBy("w").agg(F.sum("n").alias("n"), F.count("*").alias("grams")).collect():
        listed = [t["n"] for t in top if t["w"] == r["w"]]
        other[r["w"]] = max(1.0, (r["n"] - sum(listed)) / max(1, r["grams"] - len(listed)))
    table = np.array(sorted((r["gram"], r["n"]) for r in top), np.int64).reshape(-1, 2)
    return table[:, 0], table[:, 1], other


def _exploded(df: DataFrame, text_col: str, one) -> DataFrame:
    """Each row of ``df`` without its text, once per (text, position, gram, least) that ``one(grams)`` gives, and once for an empty text."""
    rest = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                grams = Grams(part.column(0).to_pylist())
                row, pos, gram, least = one(grams)
                none = np.flatnonzero(grams.size == 0)
                zero = np.zeros(len(none), np.int64)
                row = np.concatenate([row, none])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k + 1).take(take) for k in range(len(rest))], pa.array(grams.size[row].astype(np.int32)),
                     pa.array(np.concatenate([pos, zero]).astype(np.int32)), pa.array(np.concatenate([gram, zero])),
                     pa.array(np.concatenate([least, zero + 1]).astype(np.int32)), pa.array(grams.parity[row])],
                    names=[*rest, "len", "pos", "gram", "least", "parity"])

    src = df.select(text_col, *rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(run, f"{schema}, len int, pos int, gram long, least int, parity long")


def _of_part(gram: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    """Which of the segments are in part k of n."""
    return np.ones(len(gram), bool) if part[1] == 1 else gram.view(np.uint64) % np.uint64(part[1]) == np.uint64(part[0])


def _in(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of ``h`` are among the ``known`` (in order)."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(h.shape, bool)


def _chooser(threshold: float, frequent: Frequent, used: dict[int, list[int]] | None = None):
    """Which segments the texts of a batch are indexed by, for each length and width (of ``used``, by length, if known) that occur:
    (length, width, texts, positions, hashes, which of them, the least number that a similar text has, the cost of each text)."""
    known, count, other = frequent

    def rarity(h: np.ndarray, w: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        return np.where(known[at] == h, count[at], other[w]) if len(known) else np.full(h.shape, other[w])

    def choose(grams: Grams):
        for n in np.unique(grams.size[grams.size > 0]).tolist():
            texts = np.flatnonzero(grams.size == n)
            need = broken(threshold, n) + 1
            for w in (used or {}).get(n) or widths(threshold, n):
                pos = np.arange(n // w) * w
                h = grams.hashes[w][grams.first[texts][:, None] + pos]
                seen = rarity(h, w)
                order = np.argsort(seen, axis=1, kind="stable")
                seen = np.take_along_axis(seen, order, 1)
                more = (seen[:, need:need + EXTRA] <= 4 * seen[:, need - 1:need] + 64).sum(1)
                pick = np.arange(len(pos)) < (need + more)[:, None]
                # each meeting is made, whatever the count of them leaves
                yield n, w, texts, pos[order], np.take_along_axis(h, order, 1), pick, 1 + more, np.where(pick, seen, 0).sum(1)

    return choose


def index_rows(df: DataFrame, text_col: str, threshold: float, frequent: Frequent, used: dict[int, list[int]] | None = None,
               part: tuple[int, int] = (0, 1)) -> DataFrame:
    """The segments (of part k of n) that each text is found by as the longer one of a pair: len, pos, gram, the least number
    of them that a similar text has, and the numbers of the text's characters. An empty text has gram 0."""
    choose = _chooser(threshold, frequent, used)

    def one(grams: Grams):
        cost = np.full(len(grams.size), np.inf)
        width = np.zeros(len(grams.size), np.int64)
        found = list(choose(grams))
        for _, w, texts, *_, own in found:
            better = own < cost[texts]
            cost[texts[better]], width[texts[better]] = own[better], w
        rows = [[np.zeros(0, np.int64)] * 4]
        for _, w, texts, pos, h, pick, least, _ in found:
            text, at = np.nonzero(pick & (width[texts] == w)[:, None])
            rows.append([texts[text], pos[text, at], h[text, at], least[text]])
        row, pos, gram, least = (np.concatenate(c) for c in zip(*rows))
        on = _of_part(gram, part)
        return row[on], pos[on], gram[on], least[on]

    return _exploded(df, text_col, one)


def surveyed(df: DataFrame, text_col: str, threshold: float, frequent: Frequent) -> tuple[dict[int, list[int]], np.ndarray, int]:
    """The width of the segments that texts of each length are indexed by: that which costs all of them least (three
    numbers for each length); the shorter texts then ask with substrings of this width alone. The frequent segments that no
    text is indexed by, which are not asked for. About how many rows index and probes have."""
    known = frequent[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple[float, int]] = {}
        hit = np.zeros(len(known), bool)
        choose = _chooser(threshold, frequent)
        for b in batches:
            for n, w, texts, _, h, pick, _, own in choose(Grams(b.column(0).to_pylist())):
                cost, rows = total.get((n, w), (0.0, 0))
                total[n, w] = cost + float(own.sum()), rows + int(pick.sum()) + len(texts) * (n - w + 1)
                h = h[pick]
                hit[np.searchsorted(known, h[_in(known, h)])] = True
        hits = known[hit]
        none = np.zeros(len(hits), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[k[at] for k in total], none]).astype(np.int32)) for at in (0, 1)]
            + [pa.array(np.concatenate([[v[0] for v in total.values()], none]).astype(float)),
               pa.array(np.concatenate([[v[1] for v in total.values()], none]).astype(np.int64)),
               pa.array(np.concatenate([[0] * len(total), hits]).astype(np.int64))], names=["len", "width", "cost", "n", "gram"])

    best: dict[int, tuple[float, int, int]] = {}
    hits = []
    for r in (df.select(text_col).mapInArrow(run, "len int, width int, cost double, n long, gram long")
              .groupBy("len", "width", "gram").agg(F.sum("cost").alias("cost"), F.sum("n").alias("n")).collect()):
        if r["len"] == 0:
            hits.append(r["gram"])
        else:
            best[r["len"]] = min(best.get(r["len"], (np.inf, 0, 0)), (r["cost"], -r["width"], r["n"]))
    return ({n: [-w] for n, (_, w, _) in best.items()}, np.setdiff1d(known, np.array(hits, np.int64)), sum(n for *_, n in best.values()))


def chosen_widths(df: DataFrame, text_col: str, threshold: float, frequent: Frequent) -> dict[int, list[int]]:
    """The first of what ``surveyed`` finds."""
    return surveyed(df, text_col, threshold, frequent)[0]


def probe_rows(df: DataFrame, text_col: str, threshold: float, used: dict[int, list[int]] | None = None,
               idle: np.ndarray | None = None, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """The substrings (of part k of n) that each text asks with as the shorter one of a pair: len, pos, gram, and the numbers of
    the text's characters. ``used``: the widths that texts of each length are indexed by (none known: all that they may be);
    ``idle``: segments (in order) that no text is indexed by."""
    of = _asked_widths(threshold, used)

    def one(grams: Grams):
        rows = [[np.zeros(0, np.int64)] * 3]
        for w in range(1, LONGEST + 1):
            at = grams.places(w, of)
            gram = grams.hashes[w][at]
            on = _of_part(gram, part)
            if idle is not None:
                on &= ~_in(idle, gram)
            at, gram = at[on], gram[on]
            row = grams.owner[at]
            rows.append([row, at - grams.first[row], gram])
        row, pos, gram = (np.concatenate(c) for c in zip(*rows))
        return row, pos, gram, np.ones(len(row), np.int64)

    return _exploded(df, text_col, one).drop("least")


def in_place(threshold: float) -> Column:
    """Of an index row (len, pos, parity) and a probe row (len_p, pos_p, parity_p): may they be the same unbroken segment of
    similar texts? The numbers of their characters then differ by no more than what is unmatched."""
    shift = F.col("pos_p") - F.col("pos")
    unmatched = F.floor(F.lit(1 - threshold) * (F.col("len") + F.col("len_p")) + F.lit(1e-9))
    return ((F.abs(shift) + F.abs(F.col("len_p") - F.col("len") - shift) <= unmatched)
            & (F.bit_count(F.col("parity").bitwiseXOR(F.col("parity_p"))) <= unmatched))
