"""Packing: every token of every document exactly once, gapless, few sequences; tokens as the library gives them."""

import random
import zlib
from collections import defaultdict

import numpy as np

from txnclean.llm.packing import CAPACITY, pack, pack_documents
from txnclean.llm.token_counts import count_tokens
from txnclean.llm.tokens import Pieces, tokenizer_path


def texts():
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(200)] + ["don't", "É", "<|endoftext|>", "  ", "\n", "12", "\U0001f600"]
    return [None, "", " ", "a " * 9000] + [rnd.choice([" ", "\n", "  "]).join(rnd.choice(words) for _ in range(rnd.randint(1, 900))) for _ in range(200)]


def test_pieces_and_sequences(spark):
    rows = [(i if i != 7 else None, t, "x") for i, t in enumerate(texts())]
    rows += [rows[9], rows[9]]
    df = spark.createDataFrame(rows, "doc_id long, text string, _salt string").repartition(4)
    got = pack_documents(df).collect()
    tok = Pieces(tokenizer_path("word_bpe_49k.json"), True).tok
    want = []
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), CAPACITY):
            part = ids[k:k + CAPACITY]
            want.append((i, k // CAPACITY, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= CAPACITY
    total = sum(r[3] for r in want)
    assert len(by) <= -(-total // CAPACITY) + 2


def test_pack_uses_each_piece_once_and_is_tight():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 50, 20000):
        lengths = np.clip((rnd.gamma(1.5, 700, n)).astype(int), 1, CAPACITY)
        have = np.bincount(lengths, minlength=CAPACITY + 1)
        runs = pack(have)
        used = np.zeros_like(have)
        for k, pattern in runs:
            assert sum(pattern) <= CAPACITY
            np.add.at(used, list(pattern), k)
        assert (used == have).all()
        need = -(-int(lengths.sum()) // CAPACITY)
        assert sum(k for k, _ in runs) <= need * 1.01 + 1


def test_counts_equal_the_library(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    tok = Pieces(tokenizer_path("byte_bpe_50k.json"), True).tok
    for r in count_tokens(df).collect():
        t = texts()[r["doc_id"]] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(df).count() == 0 and count_tokens(df).count() == 0


def test_packing_is_near_its_bound_on_any_shape():
    import math

    import numpy as np
    from txnclean.llm.packing import feasible, pack, pack_best_fit

    rng = np.random.default_rng(0)
    shapes = {"uniform": rng.integers(1, 4097, 100_000), "200-3000": rng.integers(200, 3001, 20_000),
              "normal": np.clip(rng.normal(1200, 500, 50_000), 1, 4096).astype(int),
              "skewed": np.clip(rng.lognormal(6.2, 1.1, 50_000), 1, 4096).astype(int)}
    for name, lengths in shapes.items():
        have = np.bincount(lengths, minlength=4097).astype(np.int64)
        runs = pack(have)
        got = np.zeros(4097, np.int64)
        for n, own in runs:
            assert n > 0 and sum(own) <= 4096
            np.add.at(got, list(own), n)
        assert (got == have).all()
        total = sum(n for n, _ in runs)
        assert total <= sum(n for n, _ in pack_best_fit(have, 4096)) and total <= 1.01 * math.ceil(lengths.sum() / 4096), name
    want = feasible(np.array([[3, 2, 0, 0], [2, 2, 0, 0]]), np.array([4.0, 3.0]), np.array([0, 0, 5, 10]))
    assert (want @ np.array([1, 2]) <= 5).all() and want[0] <= 10


def test_piece_memory_is_bounded_by_bytes(monkeypatch):
    import pyarrow as pa
    from txnclean.llm import tokens

    monkeypatch.setattr(tokens, "MEMORY_BYTES", 5000)
    some = tokens.Pieces(tokens.tokenizer_path("word_bpe_49k.json"), lengths=False)
    for k in range(30):
        texts = [f"word{k} other{j} thing" for j in range(20)]
        got = some.column(pa.array(texts))
        assert got == [some._encode([t])[0] for t in texts]
        assert some.held < 5000 + 20 * 3 * 400


def test_pieces_encoded_together_are_cut_apart_as_the_library_gives_them(monkeypatch):
    """Pieces that drop blanks are encoded many at once, with a mark between them; a text that holds the mark is not."""
    import pyarrow as pa
    from txnclean.llm import tokens

    some = tokens.Pieces(tokens.tokenizer_path("word_bpe_49k.json"), lengths=False)
    calls = []
    inner = some._encode_joined
    some._encode_joined = lambda x: calls.append(len(x)) or inner(x)
    odd = ["'s it's 's", "é ́x", "<| end <|endoftext|> |>", "a  b   c", "\n x\ty  ", "", " ", "12 3² ½", "!! ?! 中文 \U0001f600"] + [f"w{k}, W{k}." for k in range(500)]
    got = some.column(pa.array(odd))
    assert calls and sum(calls) > 900
    assert got == [some._encode([t])[0] for t in odd]
    calls.clear()
    marked = ["a \x01 b \x01\x01", "new \x01word"]
    assert some.column(pa.array(marked)) == [some._encode([t])[0] for t in marked] and not calls
    some.rest()
    assert not some.old and some.column(pa.array(odd)) == got
    assert tokens.Pieces(tokens.tokenizer_path("byte_bpe_50k.json"), lengths=False).mark is None
