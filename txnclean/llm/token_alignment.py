"""Cross-tokenizer alignment by diagonal run skipping, and how often pairs of tokens are linked.

Both tokenizers' tokens are spans of the same bytes; where a token of each ends, a group ends. Ends of
A at place i and of B at place i + shift are compared: as long as stretches of 1, 2, 4, ... ends agree,
they are jumped whole, and halving finds where a stretch breaks off; each of its ends is a group of
one token and one. There, an irregular group is walked until the ends meet again, and the shift is the
new one.

Corpus-wide counts of linked pairs: a map task's documents form blocks. A block asks for the counts
of its different pairs once, packed and dealt by the A token's hash, so that a token's pairs meet in
one place and no document's links are moved for it; replies go back to the block, which scores its documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from txnclean.llm.blank_pieces import Memory, cut, laid_out
from txnclean.llm.shared import partitions, table, written
from txnclean.llm.tokens import tokenizer_path
from txnclean.llm.words import buffers, mix, slices

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Texts are cut up in slices of so many bytes (a longer text stands alone) and aligned in chunks of so many.
SLICE_BYTES = 2 << 20
#: A block's texts have about so many bytes.
BLOCK_BYTES = 8 << 20
#: An id pair is a * PAIR + b.
PAIR = 1 << 32


# --- alignment --------------------------------------------------------------------------------------

def run_length(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many ends from a[i] and b[j] on agree one to one."""
    most, n, w = min(len(a) - i, len(b) - j), 0, 1
    while n + w <= most and a[i + n:i + n + w] == b[j + n:j + n + w]:      # jump on by stretches of doubled length
        n += w
        w *= 2
    w = min(w, most - n)
    while w:                                                               # the break lies within the next w ends
        half = (w + 1) // 2
        if a[i + n:i + n + half] == b[j + n:j + n + half]:
            n += half
            w -= half
        else:
            w = half - 1
    return n


def align_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of A tokens and of B tokens of each group. Ends rise strictly, and the last of both is the same."""
    a, b = ends_a.tolist(), ends_b.tolist()
    if (a[-1:] or b[-1:]) and a[-1:] != b[-1:]:
        raise ValueError("the two rows of tokens do not end at the same place")
    runs, sizes_a, sizes_b = [], [], []
    i = j = 0
    most = len(a)
    while i < most:
        p, q = a[i], b[j]
        if p == q:
            n = run_length(a, b, i, j)
            i, j = i + n, j + n
            runs.append(n)
            if i == most:
                break
            p, q = a[i], b[j]
        else:
            runs.append(0)
        x, y = i, j
        while p != q:
            if p < q:
                x += 1
                p = a[x]
            else:
                y += 1
                q = b[y]
        sizes_a.append(x + 1 - i)
        sizes_b.append(y + 1 - j)
        i, j = x + 1, y + 1
    runs = np.array(runs, np.int64)
    at = np.cumsum(runs + 1)[:len(sizes_a)] - 1          # places of the irregular groups
    out_a = np.ones(int(runs.sum()) + len(sizes_a), np.int64)
    out_b = out_a.copy()
    out_a[at], out_b[at] = sizes_a, sizes_b
    return out_a, out_b


def links(ids_a: np.ndarray, ids_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a * PAIR + b of all linked occurrences, and the number of the A occurrence of each."""
    start = np.cumsum(sizes_b) - sizes_b
    n = np.repeat(sizes_b, sizes_a)                       # links of each A token
    end = np.cumsum(n)
    who = np.repeat(np.arange(len(n)), n)
    other = np.arange(int(end[-1]) if len(end) else 0) - (end - n)[who] + np.repeat(start, sizes_a)[who]
    return ids_a[who] * PAIR + ids_b[other], who


def groups_text(ids_a: np.ndarray, ids_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` as bytes, and where each group's text ends in it."""
    n = len(ids_a) + len(ids_b)
    end_a, end_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[np.arange(len(ids_a)) + np.repeat(end_b - sizes_b, sizes_a)] = ids_a
    ids[np.arange(len(ids_b)) + np.repeat(end_a, sizes_b)] = ids_b
    mark[end_a + (end_b - sizes_b) - 1] = ord("|")
    mark[end_a + end_b - 1] = ord(";")
    width = len(str(int(ids.max()))) if n else 1
    cells = np.zeros((n, width + 1), np.uint8)
    rest = ids
    for k in range(width - 1, -1, -1):
        cells[:, k] = np.where((rest > 0) | (k == width - 1), rest % 10 + ord("0"), 0)
        rest = rest // 10
    cells[:, width] = mark
    shown = cells != 0
    return cells[shown], np.cumsum(shown.sum(1))[end_a + end_b - 1]


# --- tokens -----------------------------------------------------------------------------------------

def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}


class Aligner:
    """Tokens of both tokenizers for pieces of texts, remembered, and alignments of texts laid out from them."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"the piece {piece!r} goes on after a word mark: texts cannot be cut at blanks")
        self.size_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.size_b = np.array(list(map(len, self.bytes_b)), np.int64)
        self.memory = Memory(self._pieces)

    def _pieces(self, parts: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        """For each piece (a blank before it): ids of A, ids of B, and a byte if both give back its bytes."""
        want = [b" " + p.encode() for p in parts]
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        ids_b = self.b.encode(parts, num_threads=1)
        out, same = [], np.ones(len(parts), bool)
        size, whole = np.fromiter(map(len, want), np.int64, len(want)), b"".join(want)
        for ids, tokens, sizes in ((ids_a, self.bytes_a, self.size_a), (ids_b, self.bytes_b, self.size_b)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), "<i4", int(n.sum()))
            end = np.cumsum(n)
            given = np.concatenate([[0], np.cumsum(sizes[flat])])
            if (given[end] != np.cumsum(size)).any() or b"".join([tokens[i] for i in flat.tolist()]) != whole:
                same &= np.array([b"".join([tokens[i] for i in own]) == w for own, w in zip(ids, want)])
            data, cuts = flat.tobytes(), (end * 4).tolist()
            out.append([data[lo:hi] for lo, hi in zip([0, *cuts[:-1]], cuts)])
        return list(zip(*out, [b"1" * s for s in same.tolist()]))

    def chunks(self, texts: pa.Array) -> Iterator[tuple]:
        """(row of each A token, ids of A, ids of B, sizes of A, sizes of B) of parts of texts that have tokens, in order of rows.

        A part ends between two words, so a text may go on in the next one.
        """
        texts = texts.fill_null("")
        rows, parts, codes, first = cut(texts)
        order = np.argsort(rows, kind="stable")
        sizes = np.diff(first)[order]
        at = np.cumsum(sizes) - sizes
        codes = codes[np.arange(len(codes)) + np.repeat(first[:-1][order] - at, sizes)]
        row = np.repeat(np.arange(len(sizes)), sizes)
        used = np.array([len(p) + 1 for p in parts], np.int64)[codes].cumsum()
        spans = [(int(a), int(b)) for a, b in _ranges(used)]
        fit = np.asarray(pc.binary_length(texts)) > 0
        if len(spans) > 1:                                 # a long text: is it given back whole?
            for lo, hi in spans:
                own, back = np.unique(codes[lo:hi], return_inverse=True)
                same = np.array([bool(v[2]) for v in self.memory.get([parts[c] for c in own])])
                fit[row[lo:hi][~same[back]]] = False
        for lo, hi in spans:
            if len(spans) == 1:
                got, back = self.memory.get(parts), codes
            else:
                own, back = np.unique(codes[lo:hi], return_inverse=True)
                got = self.memory.get([parts[c] for c in own])
            here = row[lo:hi]
            if len(spans) == 1:
                fit[here[~np.array([bool(v[2]) for v in got])[back]]] = False
            keep = fit[here]
            back, here = back[keep], here[keep]
            if not len(back):
                continue
            each = np.arange(len(back) + 1)
            ids_a, first_a = laid_out([v[0] for v in got], back, each, "<i4")
            ids_b, _ = laid_out([v[1] for v in got], back, each, "<i4")
            sizes_a, sizes_b = align_ends(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]))
            yield np.repeat(here, np.diff(first_a)), ids_a.astype(np.int64), ids_b.astype(np.int64), sizes_a, sizes_b


def _ranges(used: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of pieces of about SLICE_BYTES (used: running sums of sizes); all of them if they are not twice as many."""
    if not len(used) or used[-1] < 2 * SLICE_BYTES:
        yield 0, len(used)
        return
    lo = 0
    while lo < len(used):
        hi = max(lo + 1, int(np.searchsorted(used, (used[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        yield lo, hi
        lo = hi


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def _paths(tokenizer_a: str, tokenizer_b: str) -> tuple[str, str]:
    return tokenizer_path(tokenizer_a), tokenizer_path(tokenizer_b)


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B) -> DataFrame:
    """doc_id, ids_a, ids_b, sizes_a, sizes_b (arrays) for every row: the tokens, and how many of each every group holds in turn.

    Texts that are null, empty or not given back by both tokenizers have none. A null id stays null;
    repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
    """
    a, b = _paths(tokenizer_a, tokenizer_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, _ = buffers(batch.column(1))
            for lo, hi in slices(off, SLICE_BYTES):
                parts: list[list] = [[] for _ in range(4)]
                counts = np.zeros((4, hi - lo), np.int64)
                for row, ids_a, ids_b, sizes_a, sizes_b in aligner(a, b).chunks(batch.column(1).slice(lo, hi - lo)):
                    group = row[np.cumsum(sizes_a) - 1]
                    for k, (v, r) in enumerate(((ids_a, row), (ids_b, np.repeat(group, sizes_b)), (sizes_a, group), (sizes_b, group))):
                        parts[k].append(v)
                        counts[k] += np.bincount(r, minlength=hi - lo)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], c.cumsum()]).astype(np.int32)),
                                                  pa.array(np.concatenate([np.zeros(0, np.int64), *p]).astype(np.int32)))
                         for p, c in zip(parts, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *lists], names=["doc_id", "ids_a", "ids_b", "sizes_a", "sizes_b"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, ids_a array<int>, ids_b array<int>, sizes_a array<int>, sizes_b array<int>")


# --- counts over the corpus -------------------------------------------------------------------------

def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 on as bytes of 7 bits, the last of each below 128; and each one's end."""
    v = values.astype(np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 10):
        n += v >= np.uint64(1 << 7 * k)
    end = np.cumsum(n)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(n.max(initial=0))):
        has = np.flatnonzero(n > k)
        out[(end - n)[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((n[has] > k + 1) * np.uint8(128))
    return out, end


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    start = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64)), start).astype(np.int64)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sum of n of each."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[head], np.add.reduceat(n, head) if len(head) else n


_ROW = ("block long, kind int, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, data binary")


class Block:
    """Documents of a map task and the pairs that they hold linked."""

    def __init__(self, number: int, buckets: int):
        self.number, self.buckets, self.docs, self.bytes = number, buckets, 0, 0
        self.info: list[tuple] = []           # arrays, a tuple for each slice of texts
        self.held: list[tuple] = []           # (document, pair, times)

    def add(self, ids: pa.Array, texts: pa.Array, aligner_: Aligner, size: int) -> None:
        m = len(texts)
        counts = np.zeros((4, m), np.int64)
        hashes: dict[int, object] = {}
        for row, ids_a, ids_b, sizes_a, sizes_b in aligner_.chunks(texts):
            group = row[np.cumsum(sizes_a) - 1]
            pairs, who = links(ids_a, ids_b, sizes_a, sizes_b)
            owner = row[who]
            for k, r in enumerate((row, np.repeat(group, sizes_b), group, owner)):
                counts[k] += np.bincount(r, minlength=m)
            order = np.lexsort((pairs, owner))
            pairs, owner = pairs[order], owner[order]
            head = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])]))
            self.held.append((owner[head] + self.docs, pairs[head], np.diff(np.append(head, len(pairs)))))
            data, end = groups_text(ids_a, ids_b, sizes_a, sizes_b)
            data = data.tobytes()
            last = np.flatnonzero(np.concatenate([group[1:] != group[:-1], [True]]))
            lo = 0
            for r, hi in zip(group[last].tolist(), end[last].tolist()):
                if r in hashes:               # the text went on from the part before
                    hashes[r].update(b";")
                else:
                    hashes[r] = hashlib.sha256()
                hashes[r].update(data[lo:hi - 1])
                lo = hi
        self.info.append((ids, counts, [hashes[k].hexdigest() if k in hashes else "" for k in range(m)]))
        self.docs += m
        self.bytes += size

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row (kind 1) for each document, and one (kind 0) for each bucket of pairs that the block asks for."""
        doc, pair, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*self.held)) if self.held else [np.zeros(0, np.int64)] * 3
        known, back = np.unique(pair, return_inverse=True)
        bucket = (mix((known // PAIR).astype(np.uint64), 61) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((known, bucket))
        place = np.empty(len(known), np.int64)
        place[order] = np.arange(len(known))
        known, bucket = known[order], bucket[order]
        # a text in several parts holds a pair once
        both, times = _summed(doc * max(1, len(known)) + place[back], times)
        doc, own = both // max(1, len(known)), both % max(1, len(known))
        asked = np.bincount(own, minlength=len(known))     # documents that hold each pair

        cuts = np.searchsorted(bucket, np.unique(bucket))
        ends = np.append(cuts[1:], len(bucket))
        data = []
        for lo, hi in zip(cuts.tolist(), ends.tolist()):
            steps = np.diff(known[lo:hi], prepend=0)
            data.append(pack(np.concatenate([steps, asked[lo:hi]]))[0].tobytes())
        yield self._batch(0, bucket[cuts], data)

        steps = np.diff(own, prepend=0)
        first = np.searchsorted(doc, np.arange(self.docs + 1))
        heads = first[:-1][first[:-1] < first[1:]]
        steps[heads] = own[heads]
        many = times > 1                                   # the lowest bit tells whether a count follows the places
        coded, end = pack(steps * 2 + many)
        counts, count_end = pack(times[many])
        end, count_end = np.concatenate([[0], end]), np.concatenate([[0], count_end])
        before = np.concatenate([[0], np.cumsum(many)])
        coded, counts = coded.tobytes(), counts.tobytes()
        at = 0
        for ids, own_counts, hashes in self.info:
            data = [coded[end[a]:end[z]] + counts[count_end[before[a]]:count_end[before[z]]]
                    for a, z in zip(first[at:at + len(hashes)].tolist(), first[at + 1:at + len(hashes) + 1].tolist())]
            yield self._batch(1, np.arange(at, at + len(hashes)), data, ids, own_counts, hashes)
            at += len(hashes)

    def _batch(self, kind: int, place, data, ids=None, counts=None, hashes=None) -> pa.RecordBatch:
        m = len(data)
        counts = np.zeros((4, m), np.int64) if counts is None else counts
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, self.number, np.int64)), pa.array(np.full(m, kind, np.int32)), pa.array(np.asarray(place).astype(np.int32)),
             ids if ids is not None else pa.nulls(m, pa.int64()), *[pa.array(c) for c in counts],
             pa.array(hashes if hashes is not None else [""] * m, pa.string()), pa.array(data, pa.binary())],
            names=["block", "kind", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "data"])


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block, data) in order of bucket: to each, the count of each of its pairs, and whether it is its A token's highest."""
    held: list[tuple] = []
    at = None

    def close() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        pair = np.concatenate([h[1] for h in held])
        known, n = _summed(pair, np.concatenate([h[2] for h in held]))
        a = known // PAIR
        head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        most = np.repeat(np.maximum.reduceat(n, head), np.diff(np.append(head, len(a))))
        answer = n * 2 + (n == most)
        for block, own, _ in held:
            data = pack(answer[np.searchsorted(known, own)])[0].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([at], pa.int32()), pa.array([data], pa.binary())],
                                             names=["block", "place", "data"])

    for b in batches:
        for bucket, block, data in zip(*[b.column(i).to_pylist() for i in range(3)]):
            if bucket != at:
                yield from close()
                held, at = [], bucket
            got = unpack(data)
            m = len(got) // 2
            held.append((block, np.cumsum(got[:m]), got[m:]))
    yield from close()


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (block, kind, place): a block's replies, then its documents with their links."""
    answers: list[np.ndarray] = []
    table_: np.ndarray | None = None
    at = None
    for b in batches:
        block, kind = np.asarray(b.column(0)), np.asarray(b.column(1))
        cuts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])])) if len(block) else []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(block))):
            if block[lo] != at:
                answers, table_, at = [], None, block[lo]
            data = b.column(9).slice(lo, hi - lo).to_pylist()
            if kind[lo] == 0:
                answers += [unpack(d) for d in data]
                continue
            if table_ is None:
                table_ = np.concatenate([np.zeros(0, np.int64), *answers])
            best, total = [], []
            for d in data:
                got = unpack(d)
                # places come first: one more than there are counts after them, for each marked one
                n = _places(got)
                place, times = np.cumsum(got[:n] >> 1), np.ones(n, np.int64)
                times[(got[:n] & 1) == 1] = got[n:]
                answer = table_[place]
                best.append(int((times * (answer & 1)).sum()))
                total.append(int((times * (answer >> 1)).sum()))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i).slice(lo, hi - lo) for i in range(3, 8)], pa.array(best, pa.int64()), pa.array(total, pa.int64()), b.column(8).slice(lo, hi - lo)],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _places(got: np.ndarray) -> int:
    """How many of the numbers are places: n of them, of which as many are marked as numbers follow."""
    marked = np.concatenate([[0], np.cumsum(got & 1)])
    return int(np.searchsorted(marked + np.arange(len(got) + 1), len(got)))


def alignment_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    A pair's count is the number of rows that hold it linked (repeated rows count each). Texts that are
    null, empty or not given back by both tokenizers have zeros and an empty hash. A null id stays null;
    other columns are ignored; an empty table gives no rows. Blocks with their links are written to the shared folder.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    a, b = _paths(tokenizer_a, tokenizer_b)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = Block(number, 4 * parts)
        for batch in batches:
            off, _ = buffers(batch.column(1))
            for lo, hi in slices(off, SLICE_BYTES):
                block.add(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), aligner(a, b), int(off[hi] - off[lo]))
                if block.bytes >= BLOCK_BYTES:
                    yield from block.rows()
                    number += 1
                    block = Block(number, 4 * parts)
        if block.docs:
            yield from block.rows()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = written(src.mapInArrow(blocks, _ROW), "alignment")
    asked = made.where("kind = 0").select(F.col("place").alias("bucket"), "block", "data")
    replies = (asked.repartition(parts, "bucket").sortWithinPartitions("bucket", "block")
               .mapInArrow(_replies, "block long, place int, data binary").withColumn("kind", F.lit(0)))
    both = made.where("kind = 1").unionByName(replies, allowMissingColumns=True)
    return (both.repartition(parts, "block").sortWithinPartitions("block", "kind", "place")
            .mapInArrow(_scores, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(table(spark, sf_dir, "documents"))
