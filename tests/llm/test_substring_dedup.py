"""Substring dedup against a brute-force version."""

import hashlib
import random
import re

from txnclean.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    least = {}
    for i, ws in words:
        if i is not None:
            for k in range(len(ws) - 12):
                g = tuple(ws[k:k + 13])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - 12):
            if i is not None and least[tuple(ws[k:k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def check(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, windows string, range int")
    got = [tuple(r) for r in remove_repeats(df.repartition(5)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[2])
    assert sorted(got, key=key) == sorted(brute(docs), key=key)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["é", "中文", "a b", "x y", "\U0001f600"]
    passages = [" ".join(rnd.choice(words) for _ in range(n)) for n in (12, 13, 14, 20, 55)]
    docs = []
    for i in range(120):
        parts = [rnd.choice([" ", "\n", "\t "]).join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))]
        for _ in range(rnd.randint(0, 3)):
            parts += [rnd.choice(passages), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9)))]
        docs.append((i * 3 - 50, rnd.choice(["", "  "]) + "\x0b".join(parts)))
    docs += [(500, None), (501, ""), (502, " \n"), (None, passages[4]), (None, None), (503, docs[0][1]), (503, docs[0][1]), (503, passages[3]),
             (504, " ".join(["same"] * 60)), (505, " ".join(["same"] * 13)), (506, " ".join(rnd.choice(words) for _ in range(30000)) + " " + passages[4])]
    check(spark, docs)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0


def test_hits_from_buffers():
    import numpy as np
    import pyarrow as pa
    from txnclean.llm.substring_dedup import _hits

    rnd = np.random.default_rng(0)
    rows = [None] + [[{"range": int(r), "low": rnd.integers(0, 2 ** 31, int(rnd.integers(0, 4)), dtype=np.uint32).astype("<u4").tobytes()}
                      for r in range(int(rnd.integers(0, 4)))] for _ in range(50)]
    col = pa.array(rows, pa.list_(pa.struct([("range", pa.int32()), ("low", pa.binary())])))
    for lo, n in ((0, 51), (1, 10), (7, 20), (50, 1), (3, 0)):
        want = [(i, x["range"], int(v) << 1) for i, row in enumerate(rows[lo:lo + n]) for x in row or [] for v in np.frombuffer(x["low"], "<u4")]
        assert list(zip(*(x.tolist() for x in _hits(col.slice(lo, n))))) == want


def test_ranges_sorted_in_parts_give_the_same(spark, monkeypatch):
    from txnclean.llm import substring_dedup as sd

    words = [f"w{k}" for k in range(40)]
    rows = [(d, " ".join(words[(d * 7 + k * (1 + d % 3)) % 40] for k in range(60))) for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, sd.remove_repeats(df).collect()))
    monkeypatch.setattr(sd, "PART_ENTRIES", 50)
    import numpy as np
    keys = np.random.default_rng(1).integers(0, 90, 1000).astype(np.uint64)
    parts = list(sd._parts(keys))
    assert sorted(np.concatenate(parts).tolist()) == list(range(1000)) and len(parts) == 21
    assert sum(len(set(keys[p].tolist())) for p in parts) == len(set(keys.tolist()))
    assert whole == sorted(map(tuple, sd.remove_repeats(df).collect())) and any(r[2] for r in whole)


def test_hits_travel_by_groups_of_documents():
    """A range gives a row for each group of documents, however many they are; gathered, each document has one row."""
    import numpy as np
    import pyarrow as pa
    from txnclean.llm import substring_dedup as sd

    n = 400
    text = " ".join(f"w{k}" for k in range(80))
    got = list(sd._anchors(1, 5)([pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": [text] * n})]))
    rows = pa.Table.from_batches(got)
    parts = [sd._live(8)(rows.filter(pa.compute.equal(rows["range"], r))) for r in range(5)]
    assert all(0 < p.num_rows <= 8 for p in parts)
    every = pa.concat_tables(parts)
    want = {}
    for p in parts:
        for r in p.to_pylist():
            ids, each, low = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["each"], "<u4"), np.frombuffer(r["low"], "<u4")
            for d, x in zip(ids.tolist(), np.split(low, np.cumsum(each)[:-1])):
                assert len(set(x.tolist())) == len(x)
                want.setdefault(d, {})[r["range"]] = x.tobytes()
    found = {}
    for k in set(every["part"].to_pylist()):
        for r in sd._by_document(every.filter(pa.compute.equal(every["part"], k))).to_pylist():
            assert r["doc_id"] not in found
            found[r["doc_id"]] = {h["range"]: h["low"] for h in r["hits"]}
    assert len(found) == n and found == want
