"""Texts cut at single blanks between other characters, and what the different pieces give.

Neither a byte-level pre-tokenizer nor pieces that hold a word mark at their start alone make a token
over the border between a character that is no white space and a single blank that another such
character follows. Each different piece is therefore worked on once, and results laid end to end.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from txnclean.llm.tokens import _UNSAFE

_BORDER = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of pieces and results in the younger half of a worker's memory; when it is full it becomes the older half.
MEMORY_BYTES = 80 << 20
#: About what a remembered piece takes besides its bytes.
ENTRY_BYTES = 200


def cut(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(rows, parts, codes, first): the pieces of row ``rows[k]`` are ``parts[codes[first[k]:first[k + 1]]]``.

    Texts without null. A row's first piece has no blank before it, each other piece has one. An empty
    text has one empty piece. Texts with white space beside a blank are cut one by one, at safe blanks alone.
    """
    odd = np.asarray(pc.match_substring_regex(texts, _UNSAFE)) if len(texts) else np.zeros(0, bool)
    fast, slow = np.flatnonzero(~odd), np.flatnonzero(odd)
    split = pc.split_pattern(texts.take(pa.array(fast)) if len(slow) else texts, " ")
    off = np.asarray(split.offsets).astype(np.int64)
    coded = split.values.slice(int(off[0]), int(off[-1] - off[0])).dictionary_encode()
    parts, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
    sizes = np.diff(off)
    if len(slow):
        place = {p: i for i, p in enumerate(parts)}
        more, counts = [], []
        for i in slow.tolist():
            own = _BORDER.split(texts[i].as_py())
            counts.append(len(own))
            more += [place.setdefault(p, len(place)) for p in own]
        parts = list(place)
        codes, sizes = np.concatenate([codes, np.array(more, np.int64)]), np.concatenate([sizes, counts])
    return np.concatenate([fast, slow]), parts, codes, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class Memory:
    """Results (bytes, or tuples of them) of pieces; ``work`` makes those of pieces not seen of late."""

    def __init__(self, work: Callable[[list[str]], list]):
        self.work, self.young, self.old, self.held = work, {}, {}, 0

    def get(self, parts: list[str]) -> list:
        found = list(map(self.young.get, parts))
        todo = []
        for i in [i for i, f in enumerate(found) if f is None]:
            found[i] = self.old.get(parts[i])
            if found[i] is None:
                todo.append(i)
            else:
                self._keep(parts[i], found[i])
        for i, value in zip(todo, self.work([parts[i] for i in todo]) if todo else []):
            found[i] = value
            self._keep(parts[i], value)
        if self.held > MEMORY_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        return found

    def _keep(self, part: str, value) -> None:
        self.young[part] = value
        self.held += ENTRY_BYTES + 4 * len(part) + (len(value) if isinstance(value, bytes) else sum(map(len, value)))


def laid_out(values: list[bytes], codes: np.ndarray, first: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of type ``kind`` of the pieces end to end, and where each row's begin (and the last ends)."""
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(b"".join(values), kind)
    size = np.fromiter(map(len, values), np.int64, len(values)) // width
    at = np.cumsum(size) - size
    n = size[codes]
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    take = np.arange(total) + np.repeat(at[codes] - (end - n), n)
    return flat[take], np.concatenate([[0], end])[first]
