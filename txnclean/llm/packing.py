"""Best-fit packing by length patterns and non-negative least squares.

The driver sees only the histogram of piece lengths (at most 4096 numbers). Patterns of one to four
lengths that fill a sequence are enumerated; how often each is used is fitted to the histogram by
non-negative least squares, held to what is there and rounded down; what is left is fitted again, and the
pieces left in the end are packed best fit by count, longest first (all of them, where that takes fewer sequences). The packing is a table of runs (so many sequences of these lengths), whose
size follows the number of different lengths, not of documents. Each piece then finds its place by
its rank among the pieces of its length; ranks are counted apart in salted groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from txnclean.llm.shared import partitions, table, written
from txnclean.llm.tokens import crc32, pieces, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END = 1
#: Most tokens that a pattern leaves empty.
WASTE = 4
#: Rounds of the fit to the histogram, and to what each fit before it left.
PASSES = (150, 60, 60, 60)

Runs = list[tuple[int, tuple[int, ...]]]


def enumerate_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of four lengths (0: none) that leave at most WASTE empty; lengths: sorted, different."""
    if not len(lengths):
        return np.zeros((0, 4), np.int64)

    def best(room: np.ndarray) -> np.ndarray:
        """The longest length that fits (0: none)."""
        at = np.searchsorted(lengths, room, "right") - 1
        return np.where(at >= 0, lengths[np.maximum(at, 0)], 0)

    spread = np.unique(lengths[np.linspace(0, len(lengths) - 1, 24).astype(int)])
    zero = np.zeros(len(lengths), np.int64)
    rows = [np.stack([lengths, zero, zero, zero], 1), np.stack([lengths, best(capacity - lengths), zero, zero], 1)]
    for b in spread:
        for share in (1, 2, 3):
            second = best(np.minimum((capacity - lengths) * share // 4, b))
            room = capacity - lengths - second
            rows.append(np.stack([lengths, second, best(room), zero], 1))
            third = best(room // 2)
            rows.append(np.stack([lengths, second, third, best(room - third)], 1))
    out = -np.sort(-np.concatenate(rows), 1)
    total = out.sum(1)
    return np.unique(out[(total <= capacity) & (total >= capacity - WASTE)], axis=0)


def fit_counts(patterns: np.ndarray, have: np.ndarray, rounds: int = PASSES[0]) -> np.ndarray:
    """How often to use each pattern: non-negative least squares to the histogram, by accelerated projected gradients."""
    use = patterns > 0
    row, length = np.nonzero(use)[0], patterns[use]
    size = len(have)
    fit = lambda r: np.bincount(length, r[row], size)
    r = np.zeros(len(patterns))
    z, t = r.copy(), 1.0
    # a bound of the largest eigenvalue of A'A
    reach = np.bincount(length, minlength=size)
    step = 1.0 / max(1.0, float(np.bincount(row, reach[length], len(patterns)).max()))
    for _ in range(rounds):
        gradient = np.bincount(row, (fit(z) - have)[length], len(patterns))
        new = np.maximum(0, z - step * gradient)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, r, t = new + (t - 1) / t2 * (new - r), new, t2
    return r


def pack_best_fit(have: np.ndarray, capacity: int) -> Runs:
    """Best fit by count, longest first."""
    bins: dict[int, list[list]] = {}
    open_ = np.zeros(capacity + 1, bool)

    def put(rem: int, n: int, lengths: tuple[int, ...]) -> None:
        bins.setdefault(rem, []).append([n, lengths])
        open_[rem] = True

    for length in np.flatnonzero(have)[::-1].tolist():
        k = int(have[length])
        while k:
            fits = np.flatnonzero(open_[length:capacity])
            if not len(fits):
                q = capacity // length
                if k >= q:
                    put(capacity - q * length, k // q, (length,) * q)
                    k -= k // q * q
                else:
                    put(capacity - k * length, 1, (length,) * k)
                    k = 0
                continue
            rem = int(fits[0]) + length
            n, lengths = group = bins[rem][-1]
            m = min(n, k)
            if m == n:
                bins[rem].pop()
                open_[rem] = bool(bins[rem])
            else:
                group[0] -= m
            put(rem - length, m, (*lengths, length))
            k -= m
    return [(n, lengths) for groups in bins.values() for n, lengths in groups]


def pack(have: np.ndarray, capacity: int = CAPACITY) -> Runs:
    """have[length]: number of pieces; every piece is in exactly one sequence of the runs."""
    left = have.astype(np.int64).copy()
    out: Runs = []
    if left[capacity]:
        out.append((int(left[capacity]), (capacity,)))
        left[capacity] = 0
    for rounds in PASSES:                 # what rounding down leaves is fitted again
        patterns = enumerate_patterns(np.flatnonzero(left), capacity)
        want = feasible(patterns, fit_counts(patterns, left.astype(float), rounds), left) if len(patterns) else np.zeros(0, np.int64)
        used = np.flatnonzero(want)
        if not len(used):
            break
        for i in used:
            lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            left[lengths] -= want[i] * times
            out.append((int(want[i]), tuple(int(x) for x in patterns[i] if x)))
    out += pack_best_fit(left, capacity)
    plain = pack_best_fit(have, capacity)          # a histogram that patterns do not suit is packed without them
    return min(out, plain, key=lambda runs: sum(n for n, _ in runs))


def feasible(patterns: np.ndarray, r: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Counts scaled down so that no length is used more often than it is there, and rounded down."""
    use = patterns > 0
    row, length = np.nonzero(use)[0], patterns[use]
    need = np.bincount(length, r[row], len(have))
    share = np.minimum(1.0, have / np.maximum(need, 1e-12))
    least = np.ones(len(patterns))
    np.minimum.at(least, row, share[length])
    return np.floor(r * least + 1e-9).astype(np.int64)


def _places(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank) with the first sequence and the offset of each run of places."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for n, lengths in runs:
        at = 0
        for length in lengths:
            first = seen.get(length, 0)
            rows.append(((length << 48) + first, sequence, at))
            seen[length] = first + n
            at += length
        sequence += n
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))  # type: ignore[return-value]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                 capacity: int = CAPACITY, end: int = END, give_back: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's tokens and the end id.

    ``give_back``: workers let go of memory after each task (other stages follow in them) and encode more anew."""
    path = tokenizer_path(tokenizer)
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = pieces(path, lengths=False)
        for b in batches:
            who, k, start, size, crc = [], [], [], [], []
            for i, ids in enumerate(enc.column(b.column(1))):
                ids += tail
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at:at + 4 * capacity]
                    who.append(i)
                    k.append(at // (4 * capacity))
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(who, pa.int64())), pa.array(k, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, size, crc)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
        if give_back:
            enc.rest()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                   capacity: int = CAPACITY, give_back: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    A null or empty text is the end id alone. Null ids and repeated rows are packed like others.
    Pieces are written to the shared folder once and not tokenised again. Other columns are ignored.
    """
    rows = written(token_pieces(docs, id_col, text_col, tokenizer, capacity, give_back=give_back), "pieces")
    have = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():       # at most `capacity` rows
        have[r["length"]] = r["count"]
    keys, sequences, offsets = _places(pack(have, capacity))

    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(docs.sparkSession))))
    counts = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(own)).join(base, ["length", "_salt"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_rank") - 1).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column(3)), np.asarray(b.column(5))
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequences[at] + rank - (keys[at] & ((1 << 48) - 1))), pa.array(offsets[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
