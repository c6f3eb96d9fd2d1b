"""Exact substring dedup by fixed-block anchors.

A window is 13 consecutive words of one document. A word goes if some window over it also starts
in a document with a smaller id; windows are judged on the input. Steps, all keyed by hash or id:

1. Every document's non-overlapping blocks of 7 words are indexed, and every rolling window of
   7 words probes the index. Any repeated run of 13 words holds one whole block of the document
   it repeats, so no repeat is missed. Only 32-bit hashes travel, dealt by the hash's range; what
   the ranges find goes back packed by groups of documents, one row for a group and range.
2. Hits are extended: around a live anchor the 13-word windows are hashed (80 bits), and a
   window is covered if the smallest document that has it is smaller than its own.
3. Covered words leave; overlapping covered windows make maximal repeats.

Documents meet only through hashes; nothing of all documents reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from txnclean.llm.shared import ids_and_texts, table
from txnclean.llm.words import Words, mix, runs, space_table, valid_windows, word_batches

WINDOW = 13
BLOCK = 7
#: Words whose anchors one range of hashes holds on average (sets the number of ranges by the size of the input).
RANGE_WORDS = 1_500_000
#: Ranges whose words, on average, are those of a group of documents whose hits are gathered in one task.
GROUP_RANGES = 4
#: Entries of a range that are sorted at once.
PART_ENTRIES = 400_000


def n_ranges(docs: DataFrame, text_col: str) -> int:
    """Ranges of hashes, in proportion to the bytes of text."""
    size = docs.select(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit("")))).alias("b")).first()["b"] or 0
    return max(8, int(size / 6 / RANGE_WORDS) + 1)


def _parts(key: np.ndarray) -> Iterator[np.ndarray]:
    """Places of about PART_ENTRIES entries at a time; equal keys stay together."""
    parts = len(key) // PART_ENTRIES + 1
    if parts == 1:
        yield np.arange(len(key))
        return
    part = (mix(key.astype(np.uint64), 13) % np.uint64(parts)).astype(np.uint32)
    for k in range(parts):
        yield np.flatnonzero(part == k)


def _range_of(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _low(h: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """31 low bits of a hash, and whether it is a block's."""
    return ((h.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | flag.astype(np.uint32)).astype("<u4")


def _windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of all words, and which are of a window inside a document long enough to have repeats."""
    ok = valid_windows(w, k) & np.repeat(w.counts() >= WINDOW, w.counts())
    return runs(w.hashes, k), ok


def _by_range(ids: np.ndarray, doc: np.ndarray, payload: list[np.ndarray], rng: np.ndarray, n: int) -> Iterator[tuple]:
    """(range, ids of documents, entries of each, payloads...) for one slice of documents."""
    order = np.argsort(rng.astype(np.uint16) if n < 65536 else rng, kind="stable")
    rng, doc = rng[order], doc[order]
    payload = [p[order] for p in payload]
    cut = np.flatnonzero(np.diff(rng, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(rng)]):
        head = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
        each = np.diff(np.append(head, b - a))
        yield (int(rng[a]), ids[doc[a:b][head]].astype("<i8").tobytes(), each.astype("<u4").tobytes(),
               *[p[a:b].tobytes() for p in payload])


def _anchors(text_at: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = space_table()
        for b in batches:
            ids = np.asarray(b.column(0))
            for lo, hi, w in word_batches(b.column(text_at), table_):
                h, ok = _windows(w, BLOCK)
                if not ok.any():
                    continue
                doc = w.doc()
                at = np.arange(len(h)) - w.first[:-1][doc]
                low = _low(h, at % BLOCK == 0)
                rows = list(_by_range(ids[lo:hi], doc[ok], [low[ok]], _range_of(h[ok], n), n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]],
                    names=["range", "ids", "each", "low"])
    return run


def _extent(key: np.ndarray, more: np.ndarray | None, doc: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the smallest document among references and the largest among all with its key."""
    order = np.argsort(key, kind="stable") if more is None else np.lexsort((more, key))
    k, d, r = key[order], doc[order], ref[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    if more is not None:
        new[1:] |= more[order][1:] != more[order][:-1]
    head, group = np.flatnonzero(new), np.cumsum(new) - 1
    least = np.minimum.reduceat(np.where(r, d, np.iinfo(np.int64).max), head)
    most = np.maximum.reduceat(d, head)
    lo, hi = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    lo[order], hi[order] = least[group], most[group]
    return lo, hi


def _unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in t.column("ids")])
    each = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in t.column("each")])
    return np.repeat(ids, each), each


def _live(n_groups: int):
    """Anchors' hashes that a block and a window of different documents share, once a document, packed by groups of documents."""
    def run(t: pa.Table) -> pa.Table:
        doc, _ = _unpack(t)
        low = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in t.column("low")])
        block = (low & 1).astype(bool)
        keep = np.zeros(len(doc), bool)
        for i in _parts(low >> np.uint32(1)):
            lo, hi = _extent(low[i] >> np.uint32(1), None, doc[i], block[i])
            keep[i] = (lo < doc[i]) | (block[i] & (doc[i] < hi))
        doc, low = doc[keep], low[keep] >> np.uint32(1)
        order = np.lexsort((low, doc))
        doc, low = doc[order], low[order]
        once = np.ones(len(doc), bool)
        once[1:] = (doc[1:] != doc[:-1]) | (low[1:] != low[:-1])
        ids, at = np.unique(doc[once], return_inverse=True)
        group = (mix(ids.astype(np.uint64), 15) % np.uint64(n_groups)).astype(np.int64)
        rows = list(_by_range(ids, at, [low[once].astype("<u4")], group[at], n_groups)) if len(ids) else []
        first = t.column("range")[0].as_py()
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "range": pa.array([first] * len(rows), pa.int32()),
                         **{c: pa.array([r[i] for r in rows], pa.binary()) for i, c in ((1, "ids"), (2, "each"), (3, "low"))}})
    return run


def _by_document(t: pa.Table) -> pa.Table:
    """The hits of a group of documents, from all ranges: one row a document."""
    ids = [np.frombuffer(x.as_py(), "<i8") for x in t.column("ids")]
    each = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in t.column("each")]).astype(np.int64)
    low = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in t.column("low")])
    rng = np.repeat(np.asarray(t.column("range").combine_chunks()), [len(x) for x in ids])
    doc = np.concatenate(ids)
    order = np.argsort(doc, kind="stable")
    start = (np.cumsum(each) - each)[order]
    doc, rng, each = doc[order], rng[order], each[order]
    end = np.concatenate([[0], np.cumsum(each)])
    low = low[np.repeat(start - end[:-1], each) + np.arange(len(low))]
    packed = pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer((4 * end).astype(np.int32)), pa.py_buffer(low)])
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    hits = pa.ListArray.from_arrays(pa.array(np.append(head, len(doc)), pa.int32()), pa.StructArray.from_arrays([pa.array(rng, pa.int32()), packed], ["range", "low"]))
    return pa.table({"doc_id": pa.array(doc[head], pa.int64()), "hits": hits})


def _grow(mask: np.ndarray, before: int) -> np.ndarray:
    """True at each place up to ``before`` places ahead of a true one."""
    n = len(mask)
    s = np.concatenate([[0], np.cumsum(mask)])
    i = np.arange(n)
    return s[np.minimum(i + before + 1, n)] > s[i]


def _extend(n: int, m: int):
    """From (doc_id, text, hits): 13-word windows next to live anchors, dealt by range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = space_table()
        for b in batches:
            ids = np.asarray(b.column(0))
            hits = b.column(2)
            for lo, hi, w in word_batches(b.column(1), table_):
                h7, ok7 = _windows(w, BLOCK)
                h, ok = _windows(w, WINDOW)
                doc = w.doc()
                # anchors are looked up by document, range of hash and 31 bits
                key = _key(doc, _range_of(h7, n), h7)
                live = ok7 & np.isin(key, _key(*_hits(hits.slice(lo, hi - lo))))
                at = np.arange(len(h)) - w.first[:-1][doc]
                probe = ok & _grow(live, BLOCK - 1)
                ref = ok & _grow(live & (at % BLOCK == 0), BLOCK - 1)
                take = np.flatnonzero(probe | ref)
                if not len(take):
                    continue
                second = runs(mix(w.hashes, 7), WINDOW)
                rng = _range_of(h[take], m)
                rows = list(_by_range(ids[lo:hi], doc[take], [h[take].astype("<u8"), (second[take] >> np.uint64(48)).astype("<u2")], rng, m))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4)]],
                    names=["range", "ids", "each", "h", "h2"])
    return run


def _key(doc: np.ndarray, rng: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = h & np.uint64(0xFFFFFFFE)
    return mix(mix(doc.astype(np.uint64), 3) + mix(rng.astype(np.uint64), 5)) ^ mix(low, 9)


def _hits(hits: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, range, hash) of all hits of a slice of documents, from the list column's buffers."""
    off = np.asarray(hits.offsets).astype(np.int64)
    each = hits.values.slice(int(off[0]), int(off[-1] - off[0]))
    packed = each.field("low").cast(pa.large_binary())
    cuts = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset:packed.offset + len(packed) + 1]
    low = np.frombuffer(packed.buffers()[2], "<u4", int(cuts[-1] - cuts[0]) // 4, int(cuts[0])) if len(each) and cuts[-1] > cuts[0] else np.zeros(0, "<u4")
    n = np.diff(cuts) // 4 if len(each) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(hits)), np.diff(off))
    return np.repeat(doc, n), np.repeat(np.asarray(each.field("range")), n), low.astype(np.uint64) << np.uint64(1)


def _covered(t: pa.Table) -> pa.Table:
    """Per document the hashes of windows that a document with a smaller id has too."""
    doc, _ = _unpack(t)
    h, h2 = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(c)]) for c, kind in (("h", "<u8"), ("h2", "<u2")))
    # both hashes tell windows apart; the first finds them again in the document
    keep = np.zeros(len(doc), bool)
    for i in _parts(h):
        lo, _ = _extent(h[i], h2[i], doc[i], np.ones(len(i), bool))
        keep[i] = lo < doc[i]
    order = np.argsort(doc[keep], kind="stable")
    doc, h = doc[keep][order], h[keep][order]
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, int)
    end = np.append(head[1:], len(doc))
    return pa.table({"doc_id": pa.array(doc[head], pa.int64()),
                     "windows": pa.array([np.unique(h[a:b]).astype("<u8").tobytes() for a, b in zip(head, end)], pa.binary())})


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = space_table()
        for b in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for lo, hi, w in word_batches(b.column(1), table_):
                h, ok = _windows(w, WINDOW)
                doc, n = w.doc(), len(w.hashes)
                found = [np.frombuffer(x, "<u8") for i in range(lo, hi) for x in b.column(2)[i].as_py() or []]
                owner = [i - lo for i in range(lo, hi) for _ in b.column(2)[i].as_py() or []]
                covered = np.zeros(n, bool)
                if found:
                    want = np.concatenate([f ^ mix(np.array([o], np.uint64)) for f, o in zip(found, owner)])
                    covered = ok & np.isin(h ^ mix(doc.astype(np.uint64)), want)
                at = np.flatnonzero(covered)
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + WINDOW, -1)
                keep = np.cumsum(step[:-1]) == 0
                # bytes of kept words, and one blank after each but a document's last
                kept = np.flatnonzero(keep)
                last = np.append(doc[kept][1:] != doc[kept][:-1], True) if len(kept) else np.zeros(0, bool)
                edge = np.zeros(len(w.data) + 1, np.int64)
                edge[w.starts[kept]] += 1
                np.add.at(edge, w.ends[kept] + ~last, -1)
                mask = np.cumsum(edge[:-1]) > 0
                out = np.where(table_[w.data] == 0, np.uint8(0x20), w.data)[mask].tobytes()
                first, stop = w.first[:-1], w.first[1:]
                size = np.concatenate([[0], np.cumsum(mask)])
                left = np.concatenate([[0], np.cumsum(keep)])
                byte = np.concatenate([w.starts, [len(w.data)]])
                border = size[byte[w.first]]
                for i in range(hi - lo):
                    body = out[border[i]:border[i + 1]]
                    n_words.append(int(stop[i] - first[i]))
                    n_removed.append(int(stop[i] - first[i] - (left[stop[i]] - left[first[i]])))
                    digests.append(hashlib.sha256(body).hexdigest())
                    texts.append(body.decode("utf-8") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


def covered_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``windows``: packed hashes (unsigned 64-bit) of windows that a document with a smaller id has too.

    A document may have several rows. Null ids and null texts have no windows.
    """
    src = ids_and_texts(docs, id_col, text_col).where("doc_id is not null")
    n = n_ranges(src, "text")
    anchors = src.mapInArrow(_anchors(1, n), "range int, ids binary, each binary, low binary")
    # a document meets many ranges: what they find travels by groups of documents, not in a row for each document and range
    live = anchors.groupBy("range").applyInArrow(_live(max(8, n // GROUP_RANGES)), "part int, range int, ids binary, each binary, low binary")
    live = live.groupBy("part").applyInArrow(_by_document, "doc_id long, hits array<struct<range: int, low: binary>>")
    m = max(8, n // 8)
    near = src.join(live, "doc_id").select("doc_id", "text", "hits").mapInArrow(
        _extend(n, m), "range int, ids binary, each binary, h binary, h2 binary")
    return near.groupBy("range").applyInArrow(_covered, "doc_id long, windows binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null unless asked for) for every row.

    Null and empty texts have no words (hash of the empty string). Rows that repeat a doc_id never
    remove each other's words: neither id is smaller. Rows without an id keep all words. Other columns
    are ignored. A lost executor costs its own map tasks only.
    """
    src = ids_and_texts(docs, id_col, text_col)
    found = covered_windows(docs, id_col, text_col).groupBy("doc_id").agg(F.collect_list("windows").alias("windows"))
    # joined by id like the search's texts, in one plan: the texts are shuffled once
    both = src.where("doc_id is not null").join(found, "doc_id", "left").select("doc_id", "text", "windows")
    both = both.union(src.where("doc_id is null").withColumn("windows", F.lit(None).cast("array<binary>")))
    return both.mapInArrow(_remove(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")
