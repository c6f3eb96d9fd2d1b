"""Words of an Arrow string column as 64-bit hashes, without making Python strings.

A byte table says which bytes belong to words (0: separator) and what each counts as, so the
hash of a word depends on its bytes alone. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def space_table() -> np.ndarray:
    """Words are runs of bytes other than blank and 0x09 to 0x0D, unchanged."""
    t = np.arange(1, 257, dtype=np.uint64)
    t[[0x20, *range(0x09, 0x0E)]] = 0
    return t


def alnum_table() -> np.ndarray:
    """Words are runs of ASCII letters (either case alike), digits and non-ASCII bytes."""
    t = np.zeros(256, np.uint64)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        t[b] = b
    for b in range(0x41, 0x5B):
        t[b] = b + 0x20
    return t


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix constants)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << int(n).bit_length()
        _powers = np.full(size, _P, np.uint64)
        _inverse = np.full(size, _P_INV, np.uint64)
        _powers[0] = _inverse[0] = 1
        _powers, _inverse = np.cumprod(_powers, dtype=np.uint64), np.cumprod(_inverse, dtype=np.uint64)
    return _powers, _inverse


@dataclass
class Words:
    """hashes, byte starts and ends (in ``data``) of all words; ``first[d]:first[d + 1]`` are document d's."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray
    cum: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def prefix(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word (0 for shorter words)."""
        end = np.minimum(self.starts + n, self.ends)
        _, inv = _tables(len(self.data) + 1)
        h = mix((self.cum[end] - self.cum[self.starts]) * inv[self.starts], n)
        h[end - self.starts < n] = 0
        return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return off - off[0], data[off[0]:off[-1]]


def slices(off: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes (a longer document stands alone)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words_of(off: np.ndarray, data: np.ndarray, table: np.ndarray) -> Words:
    off = off - off[0]
    n = len(data)
    v = table[data]
    is_word = v != 0
    before = np.zeros(n + 1, bool)
    before[1:] = is_word
    cuts = off[:-1][off[:-1] < n]
    prev, nxt = before[:-1].copy(), np.zeros(n, bool)
    if n:
        nxt[:-1] = is_word[1:]
        prev[cuts] = False
        nxt[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(is_word & ~prev)
    ends = np.flatnonzero(is_word & ~nxt) + 1
    power, inv = _tables(n + 1)
    cum = np.zeros(n + 1, np.uint64)
    np.cumsum(v * power[:n], out=cum[1:])
    h = mix((cum[ends] - cum[starts]) * inv[starts])
    return Words(h, starts, ends, np.searchsorted(starts, off), data, cum)


def word_batches(col: pa.Array, table: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int, Words]]:
    """(first document, end, words) over slices of a column."""
    off, data = buffers(col)
    for lo, hi in slices(off, most):
        yield lo, hi, words_of(off[lo:hi + 1], data[off[lo]:off[hi]], table)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each place on (0s past the end; the caller masks windows that cross documents)."""
    out, got, power, width, part = None, 0, _Q, 1, h
    q = [int(_Q)]
    while k:
        if k & 1:
            if out is None:
                out, got = part.copy(), width
            else:
                shifted = np.zeros_like(part)
                shifted[:max(0, len(part) - got)] = part[got:]
                out = out * np.uint64(q[-1]) + shifted
                got += width
        k >>= 1
        if k:
            shifted = np.zeros_like(part)
            shifted[:max(0, len(part) - width)] = part[width:]
            part = part * np.uint64(q[-1]) + shifted
            width *= 2
            q.append(pow(q[-1], 2, 1 << 64))
    return mix(out)


def valid_windows(w: Words, k: int) -> np.ndarray:
    """True where a window of k words from this word on lies within its document."""
    end = np.repeat(w.first[1:], w.counts())
    return np.arange(len(w.hashes)) + k <= end


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of all k-word shingles; a shorter document has one shingle of all its words, an empty one none."""
    doc, ok = w.doc(), valid_windows(w, k)
    hs, ds = [runs(w.hashes, k)[ok]], [doc[ok]]
    n = w.counts()
    for size in range(1, k):
        short = n[doc] == size
        if short.any():
            first = short & np.isin(np.arange(len(doc)), w.first[:-1])
            hs.append(runs(w.hashes, size)[first])
            ds.append(doc[first])
    h, d = np.concatenate(hs), np.concatenate(ds)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]
