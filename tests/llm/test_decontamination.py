"""Containment search against brute force."""

import random
import re

from txnclean.llm import decontamination
from txnclean.llm.decontamination import contained_items


def words(t):
    return [w.lower() for w in re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", t or "")]


def grams(ws, k):
    return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)}


def brute(docs, items):
    out = []
    for i, t in items:
        ws = words(t)
        k = min(5, len(ws))
        want = grams(ws, k) if k else set()
        for d, u in docs:
            common = len(want & grams(words(u), k)) if k else 0
            if want and 5 * common >= 4 * len(want):
                out.append((i, d, len(want), common))
    return out


def case(seed):
    rnd = random.Random(seed)
    vocab = [f"v{k}" for k in range(500)] + ["É", "Word"]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, text(rnd.choice([6, 14, 20, 33, 60, 120]))) for i in range(40)]
    docs = []
    for d in range(150):
        body = text(rnd.choice([0, 3, 100, 800]))
        for _ in range(rnd.randint(0, 2)):
            p = list(rnd.choice(items)[1])
            for _ in range(rnd.choice([0, 0, 0, 1, 2])):
                p[rnd.randrange(len(p))] = rnd.choice(vocab)
            at = rnd.randint(0, len(body))
            body[at:at] = [w.upper() for w in p] if rnd.random() < 0.2 else p
        docs.append((d, rnd.choice([" ", "\n", ", "]).join(body)))
    items = [(i, " ".join(t)) for i, t in items] + [(90, None), (91, ""), (92, "v1 v2"), (None, docs[5][1][:80] or "v3"), (0, items[0][1] and "v7")]
    return docs + [(500, None), (None, items[3][1]), (501, items[4][1]), (501, items[4][1])], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = case(7)
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    q = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(brute(docs, items), key=key)
    for size in (16 << 20, 2000):                       # one block of items, then several
        monkeypatch.setattr(decontamination, "ITEM_BYTES", size)
        got = sorted([tuple(r)[:4] for r in contained_items(d, q).collect()], key=key)
        missed = [r for r in want if r not in got]
        assert not [r for r in got if r not in want]
        assert len(missed) <= len(want) * 0.01 and len(got) == len(want) - len(missed)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contained_items(d, q).count() == 0
    assert contained_items(q.withColumnRenamed("item_id", "doc_id"), q.limit(0)).count() == 0
