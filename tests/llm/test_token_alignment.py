"""Cross-tokenizer alignment against sets of common ends and plain counting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import txnclean.llm.token_alignment as ta
from txnclean.llm.token_alignment import align_documents, align_ends, alignment_counts, groups_text, links, op12_token_alignment, pack, run_length, unpack
from txnclean.llm.tokens import tokenizer_path

ODD = ["", " ", "  a", "a  b", "a \n b", "x\n\n\ny", "\t", "it's they'll", "日本語 テキスト", "a　b", "é́ ü", "<|endoftext|> x", "▁", "a▁b", "<0x41>", "<unk> <s>",
       "\x1c a", "a \x85b", "🙂🙂 ok", "1234567 89", "----- ===", " lead", "trail ", "a​b", "\x00\x01 \x02", "x" * 3000, " " * 500, "ﬁ ½"]


def brute_groups(ends_a, ends_b):
    common = sorted(set(ends_a) & set(ends_b))
    a, b, i, j = [], [], 0, 0
    for e in common:
        x, y = list(ends_a).index(e) + 1, list(ends_b).index(e) + 1
        a.append(x - i)
        b.append(y - j)
        i, j = x, y
    return a, b


def test_align_ends_equals_common_ends():
    rnd = random.Random(1)
    for _ in range(1500):
        n = rnd.randrange(1, 120)
        p, q = rnd.random(), rnd.random()
        a = [k for k in range(1, n) if rnd.random() < p] + [n]
        b = [k for k in range(1, n) if rnd.random() < (q if rnd.random() < 0.2 else p)] + [n]
        if rnd.random() < 0.4:      # long stretches of one to one
            b = sorted(set(a) ^ {rnd.randrange(1, n + 1)} | {n})
        got = align_ends(np.array(a), np.array(b))
        assert [x.tolist() for x in got] == list(map(list, brute_groups(a, b)))
    assert [x.tolist() for x in align_ends(np.zeros(0, int), np.zeros(0, int))] == [[], []]
    with pytest.raises(ValueError):
        align_ends(np.array([1, 2]), np.array([1, 3]))


def test_run_length_finds_the_break():
    for n in range(70):
        a = list(range(1, 71))
        b = a[:n] + [x + 0.5 for x in a[n:]]
        assert run_length(a, b, 0, 0) == n
        assert run_length(a, [0, 0, *a[:n]], 0, 2) == n         # one row ends


def test_links_and_text():
    pairs, who = links(np.array([5, 6, 7]), np.array([1, 2, 3]), np.array([2, 1]), np.array([1, 2]))
    assert [divmod(p, ta.PAIR) for p in pairs.tolist()] == [(5, 1), (6, 1), (7, 2), (7, 3)] and who.tolist() == [0, 1, 2, 2]
    data, end = groups_text(np.array([5, 60000, 0]), np.array([1, 20, 3]), np.array([2, 1]), np.array([1, 2]))
    assert data.tobytes() == b"5,60000|1;0|20,3;" and end.tolist() == [10, 17]


def test_pack_round_trip():
    values = np.array([0, 1, 127, 128, 300, 2 ** 14 - 1, 2 ** 14, 2 ** 40, 2 ** 62])
    data, end = pack(values)
    assert unpack(data.tobytes()).tolist() == values.tolist() and end[-1] == len(data)
    assert unpack(b"").tolist() == [] and len(pack(np.zeros(0, np.int64))[0]) == 0


def brute(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, hash."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(tokenizer_path(ta.TOKENIZER_A))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(ta.TOKENIZER_B))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    docs = []
    for text in texts:
        ids_a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b_tok.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            docs.append(None)
            continue
        groups, a, b = [], [], []
        ea, eb = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        common = set(ea) & set(eb)
        i = j = 0
        while i < len(ids_a):
            x, y = i, j
            while ea[x] not in common:
                x += 1
            while eb[y] not in common:
                y += 1
            groups.append((ids_a[i:x + 1], ids_b[j:y + 1]))
            i, j = x + 1, y + 1
        docs.append((ids_a, ids_b, groups, [(p, q) for g, h in groups for p in g for q in h]))
    count = Counter(p for d in docs if d for p in set(d[3]))
    top = {}
    for (p, _), n in count.items():
        top[p] = max(n, top.get(p, 0))
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        line = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in d[2])
        out.append((len(d[0]), len(d[1]), len(d[2]), len(d[3]), sum(count[x] == top[x[0]] for x in d[3]), sum(count[x] for x in d[3]),
                    hashlib.sha256(line.encode()).hexdigest()))
    return out, docs


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("small", [False, True])
def test_documents_against_brute_force(spark, small, monkeypatch):
    rnd = random.Random(2)
    words = ["the", "then", "thenates", "Onou", "colour", "é", "日本", "x1", "--", "12", "\n", "🙂", "a.b"]
    texts = ODD + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(80)] + ["the then " * 2000] + ["same text here"] * 30
    rows = [(k if k % 7 else None, t, k) for k, t in enumerate(texts)] + [(3, None, 0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_a int").repartition(3)
    if small:       # many blocks, and texts in many parts
        monkeypatch.setattr(ta, "SLICE_BYTES", 200)
        monkeypatch.setattr(ta, "BLOCK_BYTES", 500)
        block, aligner = ta.Block(0, 8), ta.Aligner(tokenizer_path(ta.TOKENIZER_A), tokenizer_path(ta.TOKENIZER_B))
        block.add(pa.array([1]), pa.array(["the then " * 2000]), aligner, 0)
        want, _ = brute(["the then " * 2000])
        assert block.info[0][2] == [want[0][6]] and block.info[0][1][:, 0].tolist() == list(want[0][:4])
        assert len(list(aligner.chunks(pa.array(["the then " * 2000])))) > 10
    want, docs = brute([t or "" for _, t, _ in rows])
    got = alignment_counts(df).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted([(r["doc_id"], *[r[c] for c in COLS]) for r in got], key=key) == sorted([(r[0], *w) for r, w in zip(rows, want)], key=key)
    aligned = align_documents(df).collect()
    assert sorted((str(r["doc_id"]), r["ids_a"], r["ids_b"], r["sizes_a"], r["sizes_b"]) for r in aligned) == sorted(
        (str(r[0]), *((d[0], d[1], [len(g) for g, _ in d[2]], [len(h) for _, h in d[2]]) if d else ([], [], [], []))) for r, d in zip(rows, docs))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment_counts(df).collect() == [] and align_documents(df).collect() == []


def test_query_over_given_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute([r["text"] or "" for r in docs])
    got = op12_token_alignment(spark, d)
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in COLS[:-1]], ("groups_sha256", "string")]
    assert sorted((r["doc_id"], *[r[c] for c in COLS]) for r in got.collect()) == sorted((r["doc_id"], *w) for r, w in zip(docs, want))
