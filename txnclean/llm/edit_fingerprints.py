"""Document fingerprints by a randomised edit embedding.

A text walks through shared random bits: at each step its present character is written down, and
the bit that the step has for that character says whether to go to the next one. Texts of small edit
distance fall into step again soon after each edit, so edit distance becomes Hamming distance of the
walks. A fingerprint keeps PLACES steps of the walk, those with the smallest hashes among its steps,
so texts of unlike lengths share the places that both reach; a step past a text's end is written as
an end mark. Likeness is the share of the longer walk's places that agree, less what chance gives.

Places in bands (bit-sampled: BAND of them each) propose similar documents, which are then verified
by the likeness of their whole fingerprints.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from txnclean.llm.components import connected_components
from txnclean.llm.shared import partitions, table, written
from txnclean.llm.words import mix

#: Kept places of a walk, and bits of each.
PLACES = 256
#: Kinds of characters for the random bits, and steps after which the bits come round again.
KINDS, PERIOD = 64, 4096
#: Steps of a walk to a character, on average.
STEPS = 2
BANDS, BAND = 24, 4
#: Texts of a band that are compared with each other, or with as many of another block, by one task.
BLOCK = 256

_bits = mix(np.arange(KINDS * PERIOD, dtype=np.uint64), 71) & np.uint64(1)


def _holds() -> np.ndarray:
    """Steps from each (kind, step) until the walk goes on: 1 plus the zeros ahead (row by kind)."""
    go = np.concatenate([_bits.reshape(KINDS, PERIOD).astype(bool)] * 2, 1)
    out = np.zeros((KINDS, 2 * PERIOD), np.int64)
    last = np.full(KINDS, 2 * PERIOD, np.int64)
    for t in range(2 * PERIOD - 1, -1, -1):
        last = np.where(go[:, t], t, last)
        out[:, t] = last - t + 1
    return out[:, :PERIOD].astype(np.uint16).reshape(-1)


_HOLD = _holds()
_HOLD_LIST = _HOLD.tolist()
#: So few texts left walk one at a time.
FEW = 32
_sampled: dict[int, np.ndarray] = {}


def sampled_places(steps: int) -> np.ndarray:
    """The PLACES steps below ``steps`` with the smallest hashes, in the order of these hashes."""
    got = _sampled.get(steps)
    if got is None:
        h = mix(np.arange(steps, dtype=np.uint64), 73)
        got = np.argpartition(h, PLACES)[:PLACES] if steps > PLACES else np.arange(steps)
        got = got[np.argsort(h[got], kind="stable")]
        if len(_sampled) > 5000:
            _sampled.clear()
        _sampled[steps] = got
    return got


def reach(n: int) -> int:
    """Steps that places are drawn from: a walk of n characters takes 2n, spread about sqrt(2n), and passes this with negligible chance."""
    return STEPS * n + 6 * (math.isqrt(STEPS * n) + 1) if n else 0


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _walk(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text the step at which each character is reached, and the step after the last (length + 1)."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    out: list = [None] * len(texts)
    lo = 0
    while lo < len(order):                       # texts of like length walk together
        top = len(texts[order[lo]])
        hi = lo + 1
        while hi < len(order) and (hi - lo) * (top + 1) < (1 << 23):
            hi += 1
        some = [texts[i] for i in order[lo:hi]]
        size = np.array([len(t) for t in some])
        kind = np.zeros((top, len(some)), np.uint8)
        for k, t in enumerate(some):
            kind[:len(t), k] = (t * np.uint32(2654435761)) >> np.uint32(26)
        at = np.zeros((top + 1, len(some)), np.int32)
        now = np.zeros(len(some), np.int32)
        live = np.searchsorted(-size, -np.arange(top), "left")        # texts longer than i come first
        few = int(np.searchsorted(-live, -FEW, "right")) if top else 0    # from here on, one text at a time
        for i in range(few):
            n = live[i]
            t = now[:n]
            t += _HOLD[kind[i, :n].astype(np.int32) * PERIOD + (t & (PERIOD - 1))]
            at[i + 1] = now
        for k in range(int(live[few]) if few < top else 0):
            step = lambda t, c: t + _HOLD_LIST[c + (t & (PERIOD - 1))]
            rest = (kind[few:size[k], k].astype(np.int32) * PERIOD).tolist()
            at[few:size[k] + 1, k] = list(accumulate(rest, step, initial=int(now[k])))
        for k, i in enumerate(order[lo:hi]):
            out[i] = at[:size[k] + 1, k]
        lo = hi
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """Hexadecimal: the length in code points (8 digits), then a digit per place; '0' marks a step past the end."""
    codes = [code_points(t) for t in texts]
    out = []
    for c, at in zip(codes, _walk(codes)):
        n = len(c)
        j = sampled_places(reach(n))
        i = np.searchsorted(at, j, "right") - 1
        on = i < n
        value = np.zeros(len(j), np.uint8)
        value[on] = 1 + mix(c[i[on]].astype(np.uint64), 75) % np.uint64(15)
        out.append(f"{n:08x}" + value.tobytes().translate(_DIGITS).decode())
    return out


_DIGITS = bytes(ord("0123456789abcdef"[i & 15]) for i in range(256))


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of the longer walk's places at which both have the same, freed of chance (1 in 15)."""
    if a == b:
        return 1.0
    n, m = int(a[:8], 16), int(b[:8], 16)
    if n < m:
        a, b, n, m = b, a, m, n
    if not m:
        return 0.0
    places = sampled_places(reach(n))
    x = np.frombuffer(a[8:].encode(), np.uint8)
    both = places < reach(m)
    # the shorter's places hold all of the longer's that lie within it, in the same order
    own = sampled_places(reach(m))
    where = np.argsort(own, kind="stable")
    y = np.frombuffer(b[8:].encode(), np.uint8)
    at = where[np.searchsorted(own[where], places[both])]
    same = ((x[both] == y[at]) & (x[both] != 0x30)).sum()
    used = (x != 0x30).sum()
    extra = (x[both] == 0x30) & (y[at] != 0x30)
    share = same / max(1, used + extra.sum())
    return float(max(0.0, (share - 1 / 15) / (1 - 1 / 15)))


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """About n - 1 ids that cut the documents into parts of like size."""
    got = docs.select(F.percentile_approx("doc_id", [(k + 1) / n for k in range(n - 1)], 20 * n).alias("q")).first()["q"] or []
    return sorted(set(got))


def with_next(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text, border) in which the row before a row of a part, by id, is its next document.

    docs: doc_id (not null) and text. Texts are shuffled once: parts are ranges of ids, and the last
    document of a part is sent to the following part too (of the last, to the first).
    """
    spark = docs.sparkSession
    bounds = np.array(_bounds(docs, 4 * partitions(spark)), np.int64)

    def part_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            if len(ids):
                part = np.searchsorted(bounds, ids, "left")
                parts = np.unique(part)
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array([int(ids[part == p].max()) for p in parts], pa.int64())], names=["part", "most"])

    top = {r["part"]: r["most"] for r in docs.select("doc_id").mapInArrow(part_ranges, "part long, most long")
           .groupBy("part").agg(F.max("most").alias("most")).collect()}         # one row a part
    order = sorted(top)
    # the last id of each part goes to the part after it as well
    follower = {top[p]: order[(k + 1) % len(order)] for k, p in enumerate(order)}
    ends = np.array(sorted(follower), np.int64)
    to = np.array([follower[e] for e in ends.tolist()], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            if not len(ids):
                continue
            part = np.searchsorted(bounds, ids, "left")
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column(0), b.column(1), pa.array(np.ones(len(ids), np.int32))], names=["part", "doc_id", "text", "own"])
            at = np.minimum(np.searchsorted(ends, ids), len(ends) - 1)
            last = np.flatnonzero(ends[at] == ids)
            if len(last):
                take = pa.array(last)
                yield pa.RecordBatch.from_arrays([pa.array(to[at[last]]), b.column(0).take(take), b.column(1).take(take), pa.array(np.zeros(len(last), np.int32))],
                                                 names=["part", "doc_id", "text", "own"])

    return docs.mapInArrow(deal, "part long, doc_id long, text string, own int").repartition(4 * partitions(spark), "part").sortWithinPartitions("part", "own", "doc_id", "text")


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, before, current = None, None, None      # before: first text of the id before; current: first of this id
    for b in batches:
        for lo in range(0, b.num_rows, 2048):
            piece = b.slice(lo, 2048)
            ps, ids, own = (piece.column(i).to_pylist() for i in (0, 1, 3))
            texts = [t or "" for t in piece.column(2).to_pylist()]
            rows, nexts = [], []
            for k in range(len(ids)):
                if ps[k] != part:
                    part, before, current = ps[k], None, None
                if current is None or ids[k] != current[0] or (own[k] and not current[2]):
                    before, current = current, (ids[k], texts[k], own[k])
                if own[k]:
                    rows.append(k)
                    nexts.append(before[1] if before else texts[k])
            if rows:
                yield _batch([ids[k] for k in rows], [texts[k] for k in rows], nexts)


def _batch(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    edited = [t[:len(t) - len(t) // 3] + n[:len(t) // 3] for t, n in zip(texts, nexts)]
    every = list(dict.fromkeys([*texts, *edited, *nexts]))
    prints = dict(zip(every, fingerprints(every)))
    a, e, n = ([prints[t] for t in x] for x in (texts, edited, nexts))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(a), pa.array(e), pa.array([likeness(x, y) for x, y in zip(a, e)]), pa.array([likeness(x, y) for x, y in zip(a, n)])],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness, and that to the next document.

    The edited text ends with the next document's first third of the length, in descending order of id
    (after the last: the first). Null texts are empty. Rows that repeat an id have the same next
    document, the first text in order of the next id. Rows without an id, and a lone id, are their own
    next document. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = with_next(src.where("doc_id is not null")).mapInArrow(_results, RESULT)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                texts = b.column(1).to_pylist()
                yield _batch(b.column(0).to_pylist(), texts, texts)

    return out.union(src.where("doc_id is null").mapInArrow(alone, RESULT))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, fingerprint) to a row per band: BAND places drawn by the band's hashes, and what they hold."""
    grid = mix(np.arange(BANDS * BAND, dtype=np.uint64), 77).reshape(BANDS, BAND)
    for b in batches:
        rows = []
        for d, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            place = sampled_places(reach(int(f[:8], 16)))
            h = mix(place.astype(np.uint64), 79)
            for k in range(BANDS):
                pick = [int(np.argmin(h ^ g)) for g in grid[k]] if len(place) >= BAND else []
                held = ",".join(f"{place[p]}:{f[8 + p]}" for p in pick) or f
                rows.append((d, f, zlib.crc32(f"{k}|{held}".encode()) * BANDS + k))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                                         names=["doc_id", "fingerprint", "band"])


def _verify(least: float):
    """Rows (band, x, y, mine, doc_id, fingerprint) in order of (band, x, y): links that span the alike pairs of two blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []          # a pair of blocks
        at = None

        def close():
            root = list(range(len(held)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            out = []
            for i, (m, d, f) in enumerate(held):
                for j in range(i):
                    n, e, g = held[j]
                    if (at[1] == at[2] or m != n) and find(i) != find(j) and likeness(f, g) >= least:
                        root[find(i)] = find(j)
                        out.append((e, d))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], names=["a", "b"])

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(6))):
                if r[:3] != at:
                    yield from close()
                    held, at = [], r[:3]
                held.append(r[3:])
        yield from close()
    return run


def edit_classes(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) for every row with an id: banding by bit samples, verified by whole fingerprints.

    Texts whose fingerprints have a likeness of ``least`` or more and share a band (BAND equal places,
    BANDS times) are linked; linked texts make a class, named by its smallest id. All pairs of a band are
    compared, those of a band over BLOCK texts in pairs of blocks, each a task's unit. Equal fingerprints are one text. Rows without an id are left out.
    """
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fingerprints([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=["doc_id", "fingerprint"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    mine = written(src.mapInArrow(prints, "doc_id long, fingerprint string"), "fingerprints")
    first = mine.groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    cut = first.select(F.col("node").alias("doc_id"), "fingerprint").mapInArrow(_bands, "doc_id long, fingerprint string, band long")
    cut = written(cut, "bands")
    blocks = cut.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    cut = cut.join(blocks, "band").withColumn("mine", F.pmod(F.xxhash64("doc_id", "fingerprint"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", F.least("mine", "o").alias("x"), F.greatest("mine", "o").alias("y"), "mine", "doc_id", "fingerprint")
    dealt = dealt.repartition(partitions(docs.sparkSession), "band", "x", "y").sortWithinPartitions("band", "x", "y", "doc_id", "fingerprint")
    found = connected_components(dealt.mapInArrow(_verify(least), "a long, b long"))
    named = first.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("class_id"))
    return mine.join(named, "fingerprint").select("doc_id", "class_id")


def op2_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_probe(table(spark, sf_dir, "documents"))
