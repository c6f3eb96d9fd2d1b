"""Token ids and counts of whole texts, by pieces that a tokenizer never joins.

A pre-tokenizer of the GPT-2 kind (and the word one that drops blanks) never makes a token over
the border between a non-blank character and a single blank that a non-blank character follows.
Texts are therefore cut there, and each different piece is encoded once per worker. What the
pieces give, laid end to end, equals encoding the whole text.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from txnclean.llm.words import buffers, slices

# White space of either library. A blank beside other white space is no safe border where white space makes tokens.
_WHITE = r"\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNSAFE = rf"[{_WHITE}] | [{_WHITE}]|\A | \z"
_BORDER = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of pieces and results in the younger half of a worker's memory; when full it becomes the older half
#: (results do not change). A remembered piece takes about ENTRY_BYTES besides its own.
MEMORY_BYTES = 96 << 20
ENTRY_BYTES = 200
#: New pieces are encoded in batches of so many characters; texts are cut up in slices of so many bytes.
BATCH_CHARS = 1 << 18
SLICE_BYTES = 4 << 20
#: A control character that is a token of its own; pieces that drop blanks are encoded in texts of about so many characters with it between them.
MARK = "\x01"
JOINED_CHARS = 640

_loaded: dict[tuple[str, bool], "Pieces"] = {}


class Pieces:
    """Encodes pieces with a ``tokenizers`` file. ``lengths``: keep counts only, else ids as bytes."""

    def __init__(self, path: str, lengths: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.whole_only = any(" " in s for s in special)      # such a string could be cut
        # does a blank before a word belong to its tokens?
        self.keeps_blank = self._encode_ids("a b") != self._encode_ids("ab") and \
            self._encode_ids(" b") != self._encode_ids("b")
        self.mark = None if self.whole_only or self.keeps_blank or any(MARK in s for s in special) else self._mark_id()
        self.lengths = lengths
        self.zero = 0 if lengths else b""
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.held = 0

    def rest(self) -> None:
        """Between tasks: the older half of the memory and what Arrow holds unused are given back."""
        self.old = {}
        pa.default_memory_pool().release_unused()

    def _encode_ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _mark_id(self) -> int | None:
        """The id of the mark, where it stands for the mark alone and never joins what is beside it."""
        ids = self._encode_ids(MARK)
        alone = len(ids) == 1 and all(
            self._encode_ids(f"{a} {MARK} {b}") == self._encode_ids(a) + ids + self._encode_ids(b)
            for a in ("", "a", "!", "\n", "<|", MARK) for b in ("", "b", "'s", "!", "\u0301", MARK))
        return ids[0] if alone else None

    def _encode_joined(self, texts: list[str]) -> list[bytes]:
        """The ids of each text (none holds a blank or the mark): many are encoded at once and cut apart at the mark's id."""
        between = f" {MARK} "
        group = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + len(between)) // JOINED_CHARS
        cut = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(texts)]
        ids = [e.ids for e in self.tok.encode_batch_fast(
            [between.join(texts[a:z]) for a, z in zip(cut[:-1], cut[1:])], add_special_tokens=False)]
        for x in ids:
            x.append(self.mark)
        flat = np.fromiter(chain.from_iterable(ids), "<u4", sum(map(len, ids)))
        end = 4 * np.flatnonzero(flat == self.mark)
        if len(end) != len(texts):
            raise ValueError(f"{len(texts)} pieces were cut apart into {len(end)}")
        data = flat.tobytes()
        return [data[a:z] for a, z in zip([0, *(end[:-1] + 4).tolist()], end.tolist())]

    def _encode(self, texts: list[str]) -> list:
        enc = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        if self.lengths:
            return [len(e.ids) for e in enc]
        ids = [e.ids for e in enc]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        data = np.fromiter(chain.from_iterable(ids), "<u4", int(n.sum())).tobytes()
        end = (4 * np.cumsum(n)).tolist()
        return [data[a:z] for a, z in zip([0, *end[:-1]], end)]

    def _values(self, parts: list[str]) -> list:
        """What each of these different pieces (without its blank) gives."""
        if self.held > MEMORY_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        found = list(map(young.get, parts))
        if None not in found:
            return found
        missing = [i for i, f in enumerate(found) if f is None]
        names = [parts[i] for i in missing]
        unknown, new = [], []
        for i, name, got in zip(missing, names, map(old.get, names)):
            if got is None:
                unknown.append(i)
                new.append(name)
            else:
                found[i] = young[name] = got
                self.held += ENTRY_BYTES + 2 * len(name) + (0 if self.lengths else len(got))
        blank = " " if self.keeps_blank else ""
        chars = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)
        lo = 0
        while lo < len(new):                     # batches balanced by size, not by number
            before = int(chars[lo - 1]) if lo else 0
            hi = min(len(new), int(np.searchsorted(chars, before + BATCH_CHARS)) + 1)
            some = new[lo:hi]
            if self.mark is None or self.lengths or MARK in "".join(some):
                values = self._encode([blank + p for p in some] if blank else some)
            else:
                values = self._encode_joined(some)
            young.update(zip(some, values))
            self.held += ENTRY_BYTES * len(some) + 2 * (int(chars[hi - 1]) - before) + (0 if self.lengths else sum(map(len, values)))
            for i, v in zip(unknown[lo:hi], values):
                found[i] = v
            lo = hi
        return found

    def _slow(self, text: str):
        """A text with odd white space: cut at safe borders only."""
        if self.whole_only:
            return self._encode([text])[0]
        parts = _BORDER.split(text)
        got = self._encode([parts[0]]) + self._encode([" " + p for p in parts[1:]])
        return sum(got) if self.lengths else b"".join(got)

    def column(self, texts: pa.Array) -> list:
        """For each text (null: empty) the number of tokens, or the ids as little-endian unsigned 32-bit values."""
        out: list = []
        texts = texts.fill_null("")
        off, _ = buffers(texts)
        for lo, hi in slices(off, SLICE_BYTES):
            out += self._slice(texts.slice(lo, hi - lo))
        return out

    def _slice(self, texts: pa.Array) -> list:
        n = len(texts)
        if self.whole_only:
            slow = np.ones(n, bool)
        elif self.keeps_blank:
            slow = np.asarray(pc.match_substring_regex(texts, _UNSAFE))
        else:
            slow = np.zeros(n, bool)
        out: list = [None] * n
        for i in np.flatnonzero(slow):
            out[i] = self._slow(texts[int(i)].as_py())
        fast = np.flatnonzero(~slow)
        if not len(fast):
            return out
        split = pc.split_pattern(texts.take(pa.array(fast)) if len(fast) < n else texts, " ")
        first = np.asarray(split.offsets).astype(np.int64)
        coded = split.values.slice(int(first[0]), int(first[-1] - first[0])).dictionary_encode()
        first = first - first[0]
        values = self._values(coded.dictionary.to_pylist())
        codes = np.asarray(coded.indices).astype(np.int64)
        heads: list = []
        if self.keeps_blank:      # a text's first piece has no blank before it
            heads = self._encode(coded.dictionary.take(pa.array(codes[first[:-1]])).to_pylist())
        if self.lengths:
            each = np.array(values, np.int64)[codes]
            if heads:
                each[first[:-1]] = heads
            got = np.add.reduceat(each, first[:-1]).tolist()
        elif heads:
            got = [h + b"".join(values[c] for c in codes[a + 1:b])
                   for h, a, b in zip(heads, first[:-1], first[1:])]
        else:
            got = _joined(values, codes, first)
        for i, g in zip(fast, got):
            out[i] = g
        return out


def _joined(values: list[bytes], codes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each text the ids of its pieces end to end."""
    flat = np.frombuffer(b"".join(values), "<u4")
    size = np.fromiter(map(len, values), np.int64, len(values)) // 4
    at = np.cumsum(size) - size
    n = size[codes]
    end = np.cumsum(n)
    take = np.arange(end[-1] if len(end) else 0) + np.repeat(at[codes] - (end - n), n)
    ids = flat[take]
    border = np.concatenate([[0], end])[first]
    return [ids[a:b].tobytes() for a, b in zip(border[:-1], border[1:])]


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)


def pieces(path: str, lengths: bool) -> Pieces:
    """One table per worker and file."""
    key = (path, lengths)
    if key not in _loaded:
        _loaded[key] = Pieces(path, lengths)
    return _loaded[key]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
