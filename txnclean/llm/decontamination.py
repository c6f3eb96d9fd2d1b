"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by size: class u holds items of more than u/2 and up to u shingles
(5 words; words as in the Jaccard join; an item of fewer words is one shingle of all of them). For
each class the shingles of a long document are cut into blocks of u, and FUNCTIONS hash functions
give each block its minima. A passage of an item of the class lies in two or three blocks, so block
and item are of like size and the item's least shingle is the block's with a chance of at least
0.27 a function at a containment of 0.8: with 28 functions 0.9998 of such items become candidates.
Candidates are verified by exact containment in the whole document's shingles.

The items are the query side; they are taken in blocks of at most ITEM_BYTES of text each (its size
is summed beforehand), and each block searches all documents. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from txnclean.llm.shared import table
from txnclean.llm.words import alnum_table, mix, runs, valid_windows, word_batches

SHINGLE = 5
CONTAINMENT = (4, 5)
FUNCTIONS = 28
ITEM_BYTES = 16 << 20

_MULTIPLIERS = mix(np.arange(FUNCTIONS, dtype=np.uint64), 61) | np.uint64(1)


class Items:
    """One block of items: shingle sets, and minima by (shingle size, class)."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, self.sets = ids, [np.zeros(0, np.uint64)] * len(ids)
        self.width = [SHINGLE] * len(ids)
        members: dict[tuple[int, int], list[int]] = {}
        for lo, _, w in word_batches(pa.array(texts, pa.string()), alnum_table()):
            for i, (a, z) in enumerate(zip(w.first[:-1], w.first[1:])):
                k = int(min(SHINGLE, z - a))
                if not k:
                    continue
                self.width[lo + i] = k
                h = w.hashes[a:z]
                self.sets[lo + i] = np.unique(runs(h, k)[:len(h) - k + 1])
                u = 1 << int(len(self.sets[lo + i]) - 1).bit_length()
                members.setdefault((k, u), []).append(lo + i)
        self.classes = {}
        for key, who in members.items():
            minima = np.array([[(self.sets[i] * a).min() for i in who] for a in _MULTIPLIERS[:1 if key[1] == 1 else FUNCTIONS]])
            order = np.argsort(minima, 1, kind="stable")
            self.classes[key] = (np.take_along_axis(minima, order, 1), np.array(who)[order])

    def candidates(self, w) -> np.ndarray:
        """Different (document, item) pairs of which a block and the item have a minimum in common."""
        doc, found = w.doc(), []
        for k in sorted({k for k, _ in self.classes}):
            ok = valid_windows(w, k)
            if not ok.any():
                continue
            h, d = runs(w.hashes, k)[ok], doc[ok]
            at = np.arange(len(w.hashes))[ok] - w.first[:-1][d]
            starts = {u: np.flatnonzero(at % u == 0) for kk, u in self.classes if kk == k}
            for j, a in enumerate(_MULTIPLIERS):
                v = None
                for u, s in starts.items():
                    minima, who = self.classes[k, u]
                    if j >= len(minima):
                        continue
                    v = h * a if v is None else v
                    m = np.minimum.reduceat(v, s) if u > 1 else v
                    lo = np.searchsorted(minima[j], m)
                    hit = np.flatnonzero(minima[j][np.minimum(lo, len(minima[j]) - 1)] == m)
                    if not len(hit):
                        continue
                    lo, hi = lo[hit], np.searchsorted(minima[j], m[hit], "right")
                    n = hi - lo
                    item = who[j][np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    found.append(np.unique(np.stack([np.repeat(d[s[hit]], n), item], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def verified(self, w) -> Iterator[tuple[int, int, int]]:
        """(document, item, common shingles) of the pairs that reach the containment."""
        pairs = self.candidates(w)
        p, q = CONTAINMENT
        last, sets = -1, {}
        for d, i in pairs.tolist():
            if d != last:
                last, sets = d, {}
            want = self.sets[i]
            k = self.width[i]
            if k not in sets:
                h = w.hashes[w.first[d]:w.first[d + 1]]
                sets[k] = np.unique(runs(h, k)[:len(h) - k + 1])
            at = np.searchsorted(sets[k], want)
            common = int((sets[k][np.minimum(at, len(sets[k]) - 1)] == want).sum())
            if q * common >= p * len(want):
                yield d, i, common


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, doc_id, n_shingles, n_common, containment) of all items contained to 0.8 or more.

    Null and empty texts contain nothing and are never contained. Null ids are returned as they are;
    repeated rows give repeated pairs. Other columns are ignored.
    """
    q = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = q.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = int(size // ITEM_BYTES) + 1
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "item_id long, doc_id long, n_shingles long, n_common long, containment double"
    out = None
    for k in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()   # ITEM_BYTES on average
        index = Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        found = src.mapInArrow(_search(index), schema)
        out = found if out is None else out.union(found)
    return out


def _search(index: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = alnum_table()
        for b in batches:
            for lo, hi, w in word_batches(b.column(1), table_):
                rows = list(index.verified(w))
                if rows:
                    n = [len(index.sets[i]) for _, i, _ in rows]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([index.ids[i] for _, i, _ in rows], pa.int64()), b.column(0).take(pa.array([lo + d for d, _, _ in rows])),
                        pa.array(n, pa.int64()), pa.array([c for _, _, c in rows], pa.int64()),
                        pa.array([c / m for (_, _, c), m in zip(rows, n)], pa.float64())],
                        names=["item_id", "doc_id", "n_shingles", "n_common", "containment"])
    return run


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
