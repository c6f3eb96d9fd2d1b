"""Jaccard join against brute force over all pairs of a small fixture."""

import random
import re

import numpy as np
import pyarrow as pa

from txnclean.llm import jaccard_join
from txnclean.llm.jaccard_join import jaccard_classes


def shingle_set(t):
    ws = [w.lower() for w in re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", t or "")]
    return frozenset(tuple(ws[i:i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def brute(docs):
    sets = [(i, shingle_set(t)) for i, t in docs]
    links, parent = [0] * len(docs), list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for b in range(a):
            j, t = sets[b]
            if i is None or j is None:
                continue
            both = len(s & t)
            if s == t or 5 * both >= 4 * (len(s) + len(t) - both) > 0:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return [(i, least[root(a)] if i is not None else None, links[a]) for a, (i, _) in enumerate(sets)]


def docs_of(seed, n=60, group=30):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["é", "Ünder", "X"]
    passage = [rnd.choice(words) for _ in range(60)]
    docs, i = [], 0
    base = [rnd.choice(words) for _ in range(150)]
    for _ in range(group):                                   # one large group of near copies
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        docs.append((i, " ".join(t)))
        i += 2
    for _ in range(n):
        t = [rnd.choice(words) for _ in range(rnd.randint(1, 200))]
        if rnd.random() < 0.5:
            t[rnd.randint(0, len(t)):0] = passage
        docs.append((i, " ".join(t)))
        i += 3
        for _ in range(rnd.randint(0, 2)):
            u = list(t)
            for _ in range(rnd.randint(0, max(1, len(u) // 25))):
                u[rnd.randrange(len(u))] = rnd.choice(words)
            docs.append((i, ", ".join(u)))
            i += 1
    return docs + [(9000, None), (9001, ""), (9002, "..."), (9003, "one two"), (9004, "One TWO!"), (None, "one two"), (9005, docs[0][1]), (9005, docs[0][1]), (9005, "something else here")]


def check(spark, docs):
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in docs], "doc_id long, text string, node int, key string")
    got = [tuple(r) for r in jaccard_classes(df.repartition(4)).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(docs), key=key)


def test_against_brute_force(spark):
    check(spark, docs_of(3))


def test_recursion_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", 12)
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    check(spark, docs_of(4, n=40, group=40))


def test_empty_table(spark):
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def nested(seed, n):
    """n triples (P, X, Y): X is 100 of P's 106 shingles, Y 81 of X's; Y links X, and P is too large for Y."""
    rnd = random.Random(seed)
    docs = []
    for k in range(n):
        w = [f"v{k}x{rnd.randrange(10 ** 9)}" for _ in range(110)]
        docs += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(w[:104])), (10 * k + 2, " ".join(w[:85]))]
    return docs


def bucket(docs, key=7):
    """One bucket's batch (key, node, n, sig) of all texts, in order of node (the document's place)."""
    got = pa.Table.from_batches(jaccard_join._nodes([pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})]))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), key)), pa.array(np.arange(len(docs))),
                                       got["n"].combine_chunks(), got["sig"].combine_chunks()], names=["key", "node", "n", "sig"])


def linked(edges, n):
    at = list(range(n))
    for a, b in edges:
        at = [at[a] if x == at[b] else x for x in at]
    return at


def test_nodes_alike_to_a_pivot_lose_no_links():
    for seed in range(12):
        docs = nested(seed, 1)
        out = [r for b in jaccard_join._split(False, 2)([bucket(docs)]) for r in b.to_pylist()]
        on = {}
        for r in out:
            if r["kind"] == 1:
                on.setdefault(r["key"], set()).add(r["node"])
        at = linked([(r["node"], r["other"]) for r in out if r["kind"] == 0], len(docs))
        assert at[1] == at[2] or any({1, 2} <= s for s in on.values())


def test_nested_copies_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", 2)
    check(spark, nested(20, 60))


def test_recall_by_depth():
    """The stated recall against paths drawn one by one, and the runs a target takes."""
    rnd = random.Random(5)

    def survives(m, depth):
        return rnd.random() < m and (depth == 1 or any(survives(m, depth - 1) for _ in range(2 if rnd.random() < 0.25 else 1)))

    for depth in (1, 4, 8):
        hits = 0
        for _ in range(4000):
            m = sum(rnd.random() < 0.8 for _ in range(64)) / 64
            hits += any(survives(m, depth) for _ in range(4))
        assert abs(hits / 4000 - jaccard_join.recall(4, depth)) < 0.025
        need = jaccard_join.runs_needed(0.999, depth)
        assert jaccard_join.recall(need, depth) >= 0.999 > jaccard_join.recall(need - 1, depth)


def test_runs_are_added_until_the_target_holds(spark, monkeypatch):
    """Pairs at 0.8 among texts that share a third: deep buckets, and no other path to a pair's link."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 2)
    made, inner = [], jaccard_join._run_edges

    def noted(nodes, first, stop, depth):
        found, reached = inner(nodes, first, stop, depth)
        made.append((first, stop, reached))
        return found, reached

    monkeypatch.setattr(jaccard_join, "_run_edges", noted)
    rnd = random.Random(8)
    word = lambda: f"u{rnd.randrange(10 ** 9)}"
    shared, docs = [word() for _ in range(124)], []
    for k in range(120):
        own = [word() for _ in range(120)]
        for side in (0, 1):
            docs.append((2 * k + side, " ".join(shared + own + [word() for _ in range(26)])))
    check(spark, docs)
    assert max(r for _, _, r in made) >= 5 and made[-1][1] >= jaccard_join.runs_needed(0.999, max(r for _, _, r in made)) > 10


def like_group(seed, n):
    """Texts some 0.85 alike: too far apart to leave with a pivot, too near to be split."""
    rnd = random.Random(seed)
    base = [f"b{k}" for k in range(400)]
    docs = []
    for i in range(n):
        t = list(base)
        for _ in range(6):
            t[rnd.randrange(len(t))] = f"z{rnd.randrange(10 ** 9)}"
        docs.append((i, " ".join(t)))
    return docs


def test_last_level_holds_blocks_only(monkeypatch):
    most = []
    inner = jaccard_join._compare
    monkeypatch.setattr(jaccard_join, "_compare", lambda node, n, sig: most.append(len(node)) or inner(node, n, sig))
    rows = bucket(like_group(9, 300))
    pieces = [rows.slice(k, 10) for k in range(0, 300, 10)]
    out = [r for b in jaccard_join._split(True, 16)(iter(pieces)) for r in b.to_pylist()]
    on = [r for r in out if r["kind"] == 1]
    assert max(most, default=0) <= 32 and len(on) > 100 and {r["key"] for r in on} == {7}
    sizes = np.bincount([r["other"] for r in on])
    assert sizes.max() == 16 and (sizes[:-1] == 16).all()


def test_last_level_in_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", 8)
    docs = like_group(10, 60) + docs_of(11, n=20, group=10)[:-9]
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_classes(df.repartition(4), depth=1).collect()]
    assert sorted(got) == sorted(brute(docs))


def test_blocks_of_a_large_bucket_span_its_pairs(spark):
    docs = like_group(12, 60)
    rows = [(7, k // 8, r["node"], r["n"], r["sig"]) for k, r in enumerate(bucket(docs).to_pylist())]
    df = spark.createDataFrame(rows, "key long, block long, node long, n int, sig binary")
    got = linked([(r["a"], r["b"]) for r in jaccard_join._block_edges(df).collect()], len(docs))
    r = bucket(docs)
    sig = np.frombuffer(b"".join(r["sig"].to_pylist()), "<u2").reshape(-1, jaccard_join.PLACES)
    want = linked(list(zip(*(x.tolist() for x in jaccard_join._compare(np.asarray(r["node"]), np.asarray(r["n"]), sig)))), len(docs))
    assert [[a == b for b in got] for a in got] == [[a == b for b in want] for a in want]


def test_every_likely_pair_of_a_large_bucket_is_linked_or_goes_on():
    docs = docs_of(13, n=40, group=20)[:-9] + nested(13, 10) + like_group(13, 30)
    random.Random(13).shuffle(docs)
    rows = bucket(docs)
    out = [r for b in jaccard_join._split(True, 16)(iter([rows.slice(k, 9) for k in range(0, len(docs), 9)])) for r in b.to_pylist()]
    at = linked([(r["node"], r["other"]) for r in out if r["kind"] == 0], len(docs))
    on = {r["node"] for r in out if r["kind"] == 1}
    sig, n = np.frombuffer(b"".join(rows["sig"].to_pylist()), "<u2").reshape(-1, jaccard_join.PLACES), np.asarray(rows["n"])
    pairs = [(i, j) for i in range(len(docs)) for j in range(i)
             if (sig[i] == sig[j]).mean() >= jaccard_join.LIKELY and jaccard_join._sizes_fit(n[[i]], n[[j]])[0]]
    assert len(pairs) > 100 and all(at[i] == at[j] or {i, j} <= on for i, j in pairs)
    assert sum(r["kind"] == 0 for r in out) < len(docs) + jaccard_join.PIVOTS


def test_very_large_buckets_are_dealt_out_anew(spark, monkeypatch):
    """Buckets beyond what a task splits by itself go on by shuffles: the same classes."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    monkeypatch.setattr(jaccard_join, "HOLD", 12)
    docs = like_group(14, 40) + docs_of(15, n=20, group=10)[:-9]
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_classes(df.repartition(4)).collect()]
    assert sorted(got) == sorted(brute(docs))


def test_a_large_group_is_linked_once_not_in_every_run(spark, monkeypatch):
    """Near copies that all runs meet in: the first run links them, the others only what it left."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 16)
    rnd = random.Random(16)
    base, docs = [f"b{k}" for k in range(300)], []
    for i in range(300):
        t = list(base)
        t[rnd.randrange(len(t))] = f"z{i}"
        docs.append((i, " ".join(t)))
    rows = bucket(docs)
    nodes = spark.createDataFrame(rows.to_pylist(), "key long, node long, n int, sig binary").select("node", "n", "sig")
    edges = jaccard_join._likely_edges(nodes, 8, 0.999).collect()
    assert len(set(linked([(r["a"], r["b"]) for r in edges], len(docs)))) == 1
    assert len(edges) < 3 * len(docs)


def test_tags_lose_no_links():
    """Rows of one tag are linked already: with these links the edges span what they span without tags."""
    docs = docs_of(17, n=40, group=20)[:-9] + like_group(17, 40)
    random.Random(17).shuffle(docs)
    rows = bucket(docs)
    for most in (16, 1024):
        plain = [r for b in jaccard_join._split(True, most)([rows]) for r in b.to_pylist()]
        at = np.array(linked([(r["node"], r["other"]) for r in plain if r["kind"] == 0], len(docs)))
        tag = np.where(np.arange(len(docs)) % 3 > 0, at, np.arange(len(docs)))
        tagged = pa.RecordBatch.from_arrays([*rows.columns, pa.array(tag)], names=["key", "node", "n", "sig", "tag"])
        out = [r for b in jaccard_join._split(True, most)([tagged]) for r in b.to_pylist()]
        known = [(int(t), k) for k, t in enumerate(tag)]
        again = linked([(r["node"], r["other"]) for r in out if r["kind"] == 0] + known, len(docs))
        first = {}
        assert all(first.setdefault(x, y) == y for x, y in zip(at.tolist(), again)) and len(set(again)) <= len(set(at.tolist()))
        assert sum(r["kind"] == 0 for r in out) < sum(r["kind"] == 0 for r in plain)
