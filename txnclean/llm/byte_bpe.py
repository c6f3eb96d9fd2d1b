"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding. Merges by rank leave a row of tokens in which each two neighbours stand apart when they are
merged alone, and a text has just one such row. So the encoding of each prefix of a match is that of a
shorter prefix and one token more, and a non-deterministic machine reads a match byte by byte: at each
place it may begin a token, walks its bytes, and accepts it if it stands apart from the token before.
The transducer is its subset construction, made lazily: a state is the set of tokens begun
and not yet ended (bytes read, token before, tokens not yet sent out). What all of them have sent in
common is sent out: the lookahead is bounded by the longest token. A step is made when it is met for the
second time; what follows one met for the first time is read by the non-deterministic machine, 64 bytes
at most, as most ends of words never come again. States are dropped and made anew when there are many
(results do not change). Each byte read is one step, whatever the match's length.

Decoding. Tokens are bytes; a machine of 11 states reads UTF-8 and holds back the bytes of a character
that has begun, so that what is fed token by token comes out in whole characters. Its steps over whole
tokens are worked out once; tokens that begin and end between characters are skipped over.
"""

from __future__ import annotations

import base64
import gc
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from txnclean.llm.blank_pieces import Memory, cut, laid_out
from txnclean.llm.shared import table
from txnclean.llm.tokens import tokenizer_path
from txnclean.llm.words import buffers, slices

RANKS = "byte_bpe_50k.tiktoken"
#: States of the transducer, and answers about neighbours, that a worker holds at most.
STATES = 100_000
NEIGHBOURS = 300_000
#: Texts are encoded in slices of so many bytes (a longer text stands alone).
SLICE_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merged(data: bytes, ranks: dict[bytes, int], below: float = math.inf) -> list[int]:
    """Merges by rank (less than ``below``) as they are defined: the least rank first, of equal ones the leftmost."""
    n = len(data)
    rank = (lambda part: r if (r := ranks.get(part)) is not None and r < below else None)
    end = list(range(1, n + 1)) + [0]          # where the part that begins here ends
    back = list(range(-1, n))                  # where the part before it begins
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i:i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, z = heapq.heappop(heap)
        j = end[i]
        if gone[i] or j >= n or end[j] != z:
            continue
        gone[j], end[i] = 1, z
        if z < n:
            back[z] = i
            if (r := rank(data[i:end[z]])) is not None:
                heapq.heappush(heap, (r, i, end[z]))
        if i and (r := rank(data[back[i]:z])) is not None:
            heapq.heappush(heap, (r, back[i], z))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i:end[i]]])
        i = end[i]
    return out


class State(dict):
    """Steps met so far: byte -> (state, tokens sent), or False if it was met once. ``items``: (place in the trie, token
    before, tokens not yet sent) of each token begun, the longest first; the last has read nothing yet."""

    __slots__ = ("items",)

    def __init__(self, items: tuple):
        self.items = items


class Transducer:
    """Encodes one match of the pattern at a time; every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.ranks, self.bytes = ranks, {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}       # of node << 8 | byte; node 0 has read nothing
        self.token: list[int | None] = [None]
        self.inner = bytearray(1)             # nodes that longer tokens pass
        for t, i in ranks.items():
            node = 0
            for b in t:
                self.inner[node] = 1
                key = node << 8 | b
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = len(self.token)
                    self.token.append(None)
                    self.inner.append(0)
            self.token[node] = i
        self.odd: dict[bytes, int] = {}       # tokens that merging never makes: a match that equals one is still that token
        self.parts: dict[int, tuple[int, int]] = {}       # the last merge of each other token
        for t, i in ranks.items():
            if len(t) > 1:
                two = merged(t, ranks, i)
                if len(two) == 2:
                    self.parts[i] = tuple(two)
                else:
                    self.odd[t] = i
        if any(max(two) > i for i, two in self.parts.items() if min(map(len, map(self.bytes.get, two))) > 1):
            raise ValueError("a token's parts need lower ranks than it has")
        self.edges: dict[tuple[int, int], list] = {}
        self.apart: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state(((0, None, ()),))

    def _state(self, items: tuple) -> State:
        got = self.states.get(items)
        if got is None:
            got = self.states[items] = State(items)
        return got

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The parts at a token's left (0) or right (1) end as it is merged: (bytes, rank at which the part is merged on)."""
        got = self.edges.get((token, side))
        if got is None:
            got = [(self.bytes[token], math.inf)]
            if token in self.parts:
                below = self._edge(self.parts[token][side], side)
                got = [*below[:-1], (below[-1][0], token), *got]
            self.edges[token, side] = got
        return got

    def _neighbours(self, before: int, token: int) -> bool:
        """Does merging both end to end leave the two? Ranks of merges rise, so a part that meets another at the
        border merges with it if that has a lower rank than what merges either part on (of equal ones, the left)."""
        left, right = self._edge(before, 1), self._edge(token, 0)
        i = j = 0
        while True:
            (x, cx), (y, cy) = left[i], right[j]
            r = self.ranks.get(x + y)
            if r is not None and r < cx and r <= cy:
                return False
            if cx <= cy:
                if cx == math.inf:
                    return True
                i += 1
            else:
                j += 1

    def _stands(self, before: int | None, token: int) -> bool:
        """Does the token stand after the one before?"""
        if self.odd and self.bytes[token] in self.odd:
            return False
        if before is None:
            return True
        key = before << 32 | token
        got = self.apart.get(key)
        if got is None:
            if len(self.apart) >= NEIGHBOURS:
                self.apart.clear()
            got = self.apart[key] = self._neighbours(before, token)
        return got

    def _read(self, begun, byte: int) -> list | None:
        """What is begun after one byte more; None if no row of neighbours explains the ranks."""
        items, last = [], None
        child, tokens, inner = self.child, self.token, self.inner
        for node, before, sent in begun:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if last is None:
                token = tokens[node]
                if token is not None and self._stands(before, token):
                    last = (0, token, sent + (token,))
            if inner[node]:
                items.append((node, before, sent))
        if last is None:
            return None
        items.append(last)
        return items

    def _settled(self, items: list) -> tuple[State, tuple]:
        """The state of what is begun, and the tokens that all of it has in common."""
        out = items[-1][2]
        n = len(out)
        for item in items:
            sent = item[2]
            if len(sent) < n:
                n = len(sent)
            while sent[:n] != out[:n]:
                n -= 1
        if n:
            items = [(node, before, sent[n:]) for node, before, sent in items]
        return self._state(tuple(items)), out[:n]

    def encode(self, match: bytes) -> list[int]:
        if match in self.odd:
            return [self.odd[match]]
        ids: list[int] = []
        k, n, state = 0, len(match), self.start
        while k < n:
            b = match[k]
            hop = state.get(b)
            if not hop:
                if hop is None:                 # met for the first time: most such rows of bytes never come again
                    state[b] = False
                    items = state.items
                    for b in match[k:k + 64]:
                        items = self._read(items, b)
                        if items is None:
                            return merged(match, self.ranks)
                    k += 64
                    if k >= n:
                        ids += items[-1][2]
                        return ids
                    state, out = self._settled(items)
                    ids += out
                    continue
                items = self._read(state.items, b)
                if items is None:
                    return merged(match, self.ranks)
                if len(self.states) > STATES:
                    held = state.items
                    self.reset()
                    state = self._state(held)
                hop = state[b] = self._settled(items)
            state, out = hop
            if out:
                ids += out
            k += 1
        ids += state.items[-1][2]
        return ids


class Encoder:
    """Whole texts to ids: matches of the pattern through the transducer, different pieces once."""

    def __init__(self, ranks: dict[bytes, int], pat: str):
        gc.set_threshold(200_000, 20, 50)       # many small lasting objects: collections would cost more than they find
        self.transducer, self.pattern = Transducer(ranks), regex.compile(pat)
        self.memory = Memory(self._pieces)

    def _pieces(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.pattern.findall, parts))
        encode = self.transducer.encode
        # in order, each match walks mostly the states of the one before
        ids = {m: encode(m.encode()) for m in sorted({m for own in found for m in own})}
        flat = [[i for m in own for i in ids[m]] for own in found]
        end = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat))) * 4
        data = np.fromiter((i for own in flat for i in own), "<i4", int(end[-1]) // 4 if len(end) else 0).tobytes()
        return [data[a:z] for a, z in zip([0, *end[:-1].tolist()], end.tolist())]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): text k (null: empty) has ids[first[k]:first[k + 1]]."""
        rows, parts, codes, start = cut(texts.fill_null(""))
        heads, own = np.unique(codes[start[:-1]], return_inverse=True)      # no blank before these
        values = self.memory.get([" " + p for p in parts]) + self.memory.get([parts[h] for h in heads])
        codes[start[:-1]] = len(parts) + own
        ids, first = laid_out(values, codes, start, "<i4")
        if (rows[1:] > rows[:-1]).all():
            return ids, first
        size = np.diff(first)
        at, n = np.empty_like(size), np.empty_like(size)
        at[rows], n[rows] = first[:-1], size
        end = np.cumsum(n)
        take = np.arange(int(end[-1])) + np.repeat(at - (end - n), n)
        return ids[take], np.concatenate([[0], end])


# --- decoding ---------------------------------------------------------------------------------------

#: Bytes held back in each state: between characters; after the first byte of two; after E0, ED and another first byte
#: of three; after two of three; after F0, F4 and another first byte of four; after two and three of four.
HELD = np.array([0, 1, 1, 1, 1, 2, 1, 1, 1, 2, 3])


def utf8_steps() -> np.ndarray:
    """Next state for each state and byte. A byte that cannot go on begins anew; one that cannot begin stands alone."""
    first = np.zeros(256, np.int8)
    first[0xC2:0xE0], first[0xE0:0xF0], first[0xF0:0xF5] = 1, 4, 8
    first[[0xE0, 0xED, 0xF0, 0xF4]] = [2, 3, 6, 7]
    step = np.tile(first, (11, 1))
    for state, lo, hi, to in ((1, 0x80, 0xBF, 0), (2, 0xA0, 0xBF, 5), (3, 0x80, 0x9F, 5), (4, 0x80, 0xBF, 5), (5, 0x80, 0xBF, 0),
                              (6, 0x90, 0xBF, 9), (7, 0x80, 0x8F, 9), (8, 0x80, 0xBF, 9), (9, 0x80, 0xBF, 10), (10, 0x80, 0xBF, 0)):
        step[state, lo:hi + 1] = to
    return step


class Vocabulary:
    """Bytes of tokens end to end, and the UTF-8 machine's steps over whole tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values()) + 1
        tokens = [b""] * n                       # an id without a token has no bytes
        for t, i in ranks.items():
            tokens[i] = t
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.fromiter(map(len, tokens), np.int64, n)
        self.at = np.cumsum(self.size) - self.size
        step, state = utf8_steps(), np.tile(np.arange(11, dtype=np.int8)[:, None], (1, n))
        for k in range(int(self.size.max())):
            has = np.flatnonzero(self.size > k)
            state[:, has] = step[state[:, has], self.data[self.at[has] + k][None, :]]
        self.steps = state

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens end to end, and each one's end."""
        n = self.size[ids]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        return self.data[np.arange(total) + np.repeat(self.at[ids] - (end - n), n)], end

    def after(self, state: int, ids: np.ndarray) -> int:
        """The UTF-8 state after these tokens."""
        steps = self.steps
        open_ = np.flatnonzero(steps[0, ids])      # between characters, only these lead elsewhere
        k = 0
        while k < len(ids):
            if state == 0:
                j = int(np.searchsorted(open_, k))
                if j == len(open_):
                    break
                k = int(open_[j])
            state = int(steps[state, ids[k]])
            k += 1
        return state


class StreamDecoder:
    """Bytes of a stream of ids in whole UTF-8 characters; bytes that are no UTF-8 pass as they are."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.state, self.held = vocabulary, 0, b""

    def feed(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        out = self.held + self.vocabulary.joined(ids)[0].tobytes()
        self.state = self.vocabulary.after(self.state, ids)
        keep = len(out) - int(HELD[self.state])
        self.held = out[keep:]
        return out[:keep]

    def finish(self) -> bytes:
        """What is held back of a character that never ended."""
        out, self.held, self.state = self.held, b"", 0
        return out


_loaded: dict[tuple, object] = {}


def _once(kind: type, *key):
    """One per worker."""
    if (kind, *key) not in _loaded:
        _loaded[(kind, *key)] = kind(read_ranks(key[0]), *key[1:])
    return _loaded[(kind, *key)]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                     pat: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, ids (array of int) for every row, as merging each match of the pattern by rank gives them.
    ``decoded`` adds what the ids give back (binary), by the same worker.

    No special tokens. Null and empty texts have no ids; a null id stays null; repeated rows give
    repeated results; other columns are ignored; an empty table gives no rows. Matches of any length
    take time in proportion to their bytes. Nothing is shuffled; a lost task is only run again.
    """
    path, pat = path or tokenizer_path(RANKS), pat or pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _once(Encoder, path, pat)
        for b in batches:
            off, _ = buffers(b.column(1))
            for lo, hi in slices(off, SLICE_BYTES):
                ids, first = encoder.batch(b.column(1).slice(lo, hi - lo))
                cols = [b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32()))]
                if decoded:
                    cols.append(_decoded(_once(Vocabulary, path), ids, first))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"][:len(cols)])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def _decoded(vocabulary: Vocabulary, ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """What rows of ids give, each a stream of its own."""
    stream, out = StreamDecoder(vocabulary), []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(stream.feed(ids[a:z]) + stream.finish())
    return pa.array(out, pa.binary())


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded (binary) for every row of (doc_id, ids); null ids: empty. Ids without a token have no bytes."""
    path = path or tokenizer_path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _once(Vocabulary, path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):            # rows of one result
                col = b.column(1).slice(lo, 256).fill_null([])
                first = np.asarray(col.offsets).astype(np.int64)
                out = _decoded(vocabulary, np.asarray(col.values), first)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), b.column(1).slice(lo, 256), out], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode_documents(table(spark, sf_dir, "documents"), decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
