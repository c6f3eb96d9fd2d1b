"""Fingerprints: a step-by-step walk, edited texts by brute force, likeness against edits, classes."""

import hashlib
import random

import numpy as np

from txnclean.llm import edit_fingerprints as E


def slow_walk(text):
    """Step by step, by the bits themselves."""
    kinds = ((E.code_points(text) * np.uint32(2654435761)) >> np.uint32(26)).tolist()
    i, out, t = 0, [0], 0
    while i < len(kinds):
        if E._bits[kinds[i] * E.PERIOD + t % E.PERIOD]:
            i += 1
            out.append(t + 1)
        t += 1
    return out


def text(rnd, n):
    return "".join(rnd.choice("abcdefgh é中\U0001f600") for _ in range(n))


def test_walk():
    rnd = random.Random(1)
    texts = [text(rnd, n) for n in [0, 1, 2, 50, 5000, 9000, *[rnd.randint(0, 300) for _ in range(60)]]]
    for t, at in zip(texts, E._walk([E.code_points(t) for t in texts])):
        assert at.tolist() == slow_walk(t)
    one = E.fingerprints(texts)
    assert one == [E.fingerprints([t])[0] for t in texts]


def test_likeness_follows_edits():
    rnd = random.Random(2)
    far, near, third = [], [], []
    for _ in range(40):
        a, b = text(rnd, 2000), text(rnd, rnd.randint(1500, 2500))
        c = list(a)
        for _ in range(10):
            c[rnd.randrange(len(c))] = "z"
        c.insert(700, "zz")
        f = E.fingerprints([a, b, "".join(c), a[:1334] + b[:666]])
        far.append(E.likeness(f[0], f[1]))
        near.append(E.likeness(f[0], f[2]))
        third.append(E.likeness(f[0], f[3]))
        assert E.likeness(f[0], f[0]) == 1 and abs(E.likeness(f[0], f[1]) - E.likeness(f[1], f[0])) < 1e-12
    assert np.mean(far) < 0.2 and np.mean(near) > 0.75 and 0.55 < np.mean(third) < 0.8


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    first = {i: min(t or "" for j, t in rows if j == i) for i in ids}
    out = []
    for i, t in rows:
        t = t or ""
        nxt = t if i is None else first[ids[ids.index(i) - 1]]
        k = len(t) // 3
        edited = t[:len(t) - k] + nxt[:k]
        f, g, h = E.fingerprints([t, edited, nxt])
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, E.likeness(f, g), E.likeness(f, h)))
    return out


def test_probe_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(-1000, 1000), text(rnd, rnd.choice([0, 3, 40, 200]))) for _ in range(300)]
    rows += [(5000, None), (None, "some text without an id"), (None, None), (5001, "x" * 20000), rows[3], rows[3], (rows[4][0], "another"), (-5000, "")]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for n in (1, 6):
        df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, part int, own int").repartition(n)
        got = [tuple(r) for r in E.edit_probe(df).collect()]
        assert sorted(got, key=key) == sorted(brute(rows), key=key)
    lone = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert E.edit_probe(lone).first()["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert E.edit_probe(lone.limit(0)).count() == 0


def test_classes(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for g in range(20):
        base = text(rnd, 800)
        for k in range(rnd.randint(1, 5)):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(800)] = "z"
            rows.append((g * 10 + k, "".join(t)))
            want[g * 10 + k] = g * 10
    rows += [(900, ""), (901, None), (902, "ab"), (None, "ab")]
    want |= {900: 900, 901: 900, 902: 902}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in E.edit_classes(df, least=0.5).collect()}
    # a walk may stay out of step for long after an edit; different texts must never meet
    assert set(got) == set(want) and sum(got[i] != want[i] for i in got) <= 0.1 * len(want)
    assert all(got[i] // 10 == i // 10 for i in got if i < 900) and (got[900], got[901], got[902]) == (900, 900, 902)


def chain(rnd, n, links):
    """Texts of which each replaces a like share of the one before, at the end of what is left."""
    t, out = text(rnd, n), []
    for k in range(links):
        out.append(t)
        at, size = n - (k + 1) * n // 7, n // 7
        t = t[:at] + text(rnd, size) + t[at + size:]
    return out


def test_chains_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 3)
    rnd = random.Random(9)
    texts = [t for _ in range(12) for t in chain(rnd, 900, 6)]
    rnd.shuffle(texts)
    prints = E.fingerprints(texts)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if E.likeness(prints[i], prints[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {i: root(i) for i in range(len(texts))}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in E.edit_classes(df).collect()} == want
    assert 12 <= len(set(want.values())) < 40


def test_alike_members_that_share_no_leader():
    """d joins leader x; e is alike to d and not to x: the three are one class, though e comes last."""
    rnd = random.Random(10)
    for _ in range(200):
        texts = chain(rnd, 900, 3)
        x, d, e = E.fingerprints(texts)
        if E.likeness(x, d) >= 0.8 and E.likeness(d, e) >= 0.8 and E.likeness(x, e) < 0.8:
            break
    else:
        raise AssertionError("no such chain")
    rows = E.pa.RecordBatch.from_pydict({"band": [5] * 3, "x": [0] * 3, "y": [0] * 3, "mine": [0] * 3, "doc_id": [0, 1, 2], "fingerprint": [x, d, e]})
    out = [(r["a"], r["b"]) for b in E._verify(0.8)([rows]) for r in b.to_pylist()]
    assert sorted(out) == [(0, 1), (1, 2)]


def test_every_character_can_be_reached():
    """Short texts that differ in the last character alone: all places of their walks are kept, so prints differ unless digits collide."""
    rnd = random.Random(11)
    same = 0
    for _ in range(200):
        t = text(rnd, 50)
        codes = E._walk([E.code_points(t)])[0]
        assert codes[-1] <= E.reach(50)
        a, b = E.fingerprints([t[:-1] + "x", t[:-1] + "y"])
        same += a == b
    assert same == 0
