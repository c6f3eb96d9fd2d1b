"""Byte-level BPE against the tiktoken library, merges as defined, and Python's own UTF-8."""

import hashlib
import random

import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import txnclean.llm.blank_pieces as blank_pieces
import txnclean.llm.byte_bpe as byte_bpe
from txnclean.llm.byte_bpe import (HELD, Encoder, StreamDecoder, Transducer, Vocabulary, decode_documents, encode_documents,
                                   merged, op13_byte_bpe, pattern, read_ranks, utf8_steps)
from txnclean.llm.tokens import tokenizer_path

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
ODD = ["", " ", "  a", "a  b", "a \n b", "x\n\n\ny", "\t", "it's they'll I'd", "日本語 テキスト", "a　b", "é́", "<|endoftext|> x", "▁",
       "\x1c a", "a \x85b", "🙂🙂 ok", "1234567 89", "----------- ===", "don 't", " lead", "trail ", "a​b", "\x00\x01 \x02", "x" * 5000, " " * 3000]


@pytest.fixture(scope="module", params=FILES)
def ranks(request):
    return read_ranks(tokenizer_path(request.param))


def library(ranks):
    return tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_merges(ranks, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STATES", 300)           # states are dropped again and again
    monkeypatch.setattr(byte_bpe, "NEIGHBOURS", 500)
    machine, rnd, tokens = Transducer(ranks), random.Random(3), list(ranks)
    for k in range(3000):
        s = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 25))), bytes(rnd.choice(b"aabeinrst ") for _ in range(rnd.randrange(1, 40))),
             b"".join(rnd.choice(tokens) for _ in range(rnd.randrange(1, 5))), bytes([rnd.choice(b"-=.\n a\xc3\x82")]) * rnd.randrange(1, 200)][k % 4]
        assert machine.encode(s) == ([ranks[s]] if s in ranks else merged(s, ranks)), s


def test_small_vocabulary_by_hand():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259}
    machine = Transducer(ranks)
    assert machine.encode(b"abc") == [258] and machine.encode(b"xbc") == [ord("x"), 257]
    assert machine.encode(b"aaab") == [259, 256] and machine.encode(b"aaa") == [259, ord("a")] and machine.encode(b"") == []
    with pytest.raises(ValueError):
        Transducer({b"a": 0})


def test_tokens_that_merges_never_make():
    ranks = {bytes([b]): b for b in range(256)} | {b"xyz": 256}        # neither xy nor yz has a rank
    machine = Transducer(ranks)
    want = library(ranks)
    for s in ("xyz", "xyzxyz", "axyz", "xy"):
        assert machine.encode(s.encode()) == want._encode_single_piece(s.encode()), s


def test_texts_equal_the_library(ranks, monkeypatch):
    monkeypatch.setattr(blank_pieces, "MEMORY_BYTES", 20_000)
    encoder, want, rnd = Encoder(ranks, pattern()), library(ranks), random.Random(5)
    chars = [" ", " ", "a", "th", "E", "é", "日", "🙂", "1", ".", "'s", "\n", "\t", " ", "\x1c", "\x85", " "]
    texts = ODD + ["".join(rnd.choice(chars) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    for lo in range(0, len(texts), 700):
        some = texts[lo:lo + 700]
        ids, first = encoder.batch(pa.array(some))
        for k, text in enumerate(some):
            assert ids[first[k]:first[k + 1]].tolist() == want.encode_ordinary(text), text


def begun(data: bytes) -> int:
    """Bytes at the end that some further bytes make one character."""
    def whole(b):
        try:
            return len(b.decode()) == 1
        except UnicodeDecodeError:
            return False
    for n in (3, 2, 1):
        if len(data) >= n and any(whole(data[-n:] + bytes([b]) + b"\x80" * k) for b in (0x80, 0x90, 0xA0) for k in range(3)):
            return n
    return 0


def test_utf8_machine_holds_back_what_has_begun():
    step, rnd = utf8_steps(), random.Random(7)
    for _ in range(4000):
        data = b"".join(rnd.choice([b"a", "é".encode(), "日".encode(), "🙂".encode(), b"\xe0\xa0", b"\xed\xa0", b"\xf4\x90", b"\xc0", b"\x80", b"\xf0\x90"])
                        for _ in range(rnd.randrange(1, 6)))
        data = data[:rnd.randrange(1, len(data) + 1)]
        state = 0
        for b in data:
            state = int(step[state, b])
        assert begun(data) == HELD[state], data


def test_stream_decoder_gives_whole_characters(ranks):
    vocabulary, want = Vocabulary(ranks), library(ranks)
    text = "naïve 日本語 🙂🙂 ﷽ word " * 20 + "𝔘𝔫𝔦"
    ids = want.encode_ordinary(text)
    for width in (1, 2, 7, 10_000):
        stream = StreamDecoder(vocabulary)
        out = [stream.feed(ids[k:k + width]) for k in range(0, len(ids), width)] + [stream.finish()]
        assert "".join(o.decode() for o in out) == text            # each chunk is whole characters
    bad = [ranks[b"\xe6"], ranks[b"a"], ranks[b"\xf0"]]
    stream = StreamDecoder(vocabulary)
    assert stream.feed(bad) == b"\xe6a" and stream.finish() == b"\xf0"


def test_documents(spark):
    rows = [(1, "hello  world", 5), (1, "hello  world", 5), (None, "x", 1), (3, None, 2), (4, "", 3), (5, "日本 \n" * 4000, 4)] + \
           [(10 + k, t, 0) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids int").repartition(3)
    want = library(read_ranks(tokenizer_path(byte_bpe.RANKS)))
    got = decode_documents(encode_documents(df)).collect()
    assert sorted((r["doc_id"] or 0, r["ids"], bytes(r["decoded"])) for r in got) == sorted(
        (i or 0, want.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert decode_documents(encode_documents(df.limit(0))).collect() == []


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [50255, 99999999 % 50256])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in decode_documents(df).collect()}
    assert got[1] == b"" and got[2]


def test_query_equals_the_library(spark):
    sf_dir = "/root/testdata/sf0.001"
    want = library(read_ranks(tokenizer_path(byte_bpe.RANKS)))
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op13_byte_bpe(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = want.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
