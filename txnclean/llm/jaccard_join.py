"""N-gram Jaccard join by chosen paths.

Documents are sets of 5-word shingles (words: runs of ASCII letters and digits, either case alike,
and non-ASCII characters; a shorter text is one shingle of all its words). Equal sets are one node.

1. Each set becomes PLACES sampled tokens (one-permutation min-hashes): two sets share each place
   with a chance equal to their similarity.
2. Each run splits all nodes by one place's token; buckets over BUCKET nodes are split
   again by one or two places that the path chooses (1.25 on average: one shared child is expected
   at similarity 0.8), level by level: where they are up to HOLD nodes, by one shuffle a level above. Small buckets are compared by brute
   force on the sampled tokens; likely pairs (0.55 or more) give edges, of which a bucket keeps a
   spanning forest. In a large bucket, nodes that all but equal one of a few pivots (ALIKE of the
   sampled tokens) are linked to it and go no further. So that no pair of theirs is lost, all nodes
   are linked to each pivot they share NEAR = LIKELY + ALIKE - 1 with, whatever their sizes: two nodes
   that share LIKELY, one of them ALIKE with a pivot, both share as much with that pivot. Nodes linked to one
   group of pivots are in one component already, so a path whose nodes are all of one group ends: the
   rows of a large group of near copies go no deeper. A pair of similarity 0.8 survives a
   run with a chance of 0.8, 0.67, 0.58, 0.51 at depths 1 to 4 and 0.35 at depth 8. What the first run links
   a node to is its tag from then on: nodes of one tag are in one component, so later runs give an edge for two
   tags that meet in a bucket, not for every node of a large group of near copies again, and buckets of one tag end.
   RUNS runs are made first; then, as long as the deepest level that had rows leaves the recall of such a pair
   below the target, as many more as it takes (10 runs for 0.999 at depth 3, 13 at 4, 29 at 8).
   What is left of a large bucket at the last level is cut in blocks of BUCKET nodes, and pairs of
   blocks are compared apart.
3. Every true link lies inside a component of these edges. There, whole shingle sets are compared
   exactly; components over BLOCK nodes are cut in blocks, and pairs of blocks are compared apart.
   Tasks return numbers of links and spanning forests, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from txnclean.llm.components import connected_components
from txnclean.llm.shared import partitions, table, written
from txnclean.llm.words import alnum_table, mix, shingles, word_batches

SHINGLE = 5
#: Least similarity of a link, as a fraction in whole numbers.
THRESHOLD = (4, 5)
PLACES = 64
#: Runs made at once; more follow until the recall of a pair at the threshold reaches the target.
RUNS = 10
RECALL = 0.999
BUCKET = 1024
#: Rows of a bucket that its task splits on by itself, to the last level; larger buckets are dealt out anew level by level.
HOLD = 1 << 16
BLOCK = 1024
#: Bytes of text that a task hashes at once; its arrays take many times as much.
SLICE_BYTES = 1 << 20
PIVOTS = 16
LIKELY = 0.55
ALIKE = 0.92
#: Least agreement with a pivot of whatever is likely with a node that the pivot stands for.
NEAR = LIKELY + ALIKE - 1

_NODE = "doc_id long, node long, n int, sig binary"


def token_sets(h: np.ndarray, d: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different tokens of each document: (tokens, borders)."""
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.searchsorted(d, np.arange(n_docs + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """PLACES 16-bit sampled tokens per set (h: tokens sorted within each set); empty sets have zeros."""
    n = len(first) - 1
    size = np.diff(first)
    doc = np.repeat(np.arange(n), size)
    place = (h >> np.uint64(58)).astype(np.int64)
    slot = doc * PLACES + place
    head = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, int)
    out = np.zeros(n * PLACES, np.uint64)
    full = np.zeros(n * PLACES, bool)
    out[slot[head]] = h[head]
    full[slot[head]] = True
    out, full = out.reshape(n, PLACES), full.reshape(n, PLACES)
    # an empty place takes the token of the next place in an order of its own
    rows = np.flatnonzero((~full).any(1) & (size > 0))
    for k in range(PLACES):
        todo = rows[~full[rows, k]]
        tries = 0
        while len(todo):
            j = int(mix(np.array([k * 1000003 + tries], np.uint64), 21)[0] % np.uint64(PLACES))
            hit = todo[full[todo, j]]
            out[hit, k] = out[hit, j] + np.uint64(tries + 1)
            todo = todo[~full[todo, j]]
            tries += 1
    return (mix(out, 2) >> np.uint64(48)).astype("<u2")


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table_ = alnum_table()
    for b in batches:
        for lo, hi, w in word_batches(b.column(1), table_, SLICE_BYTES):
            h, first = token_sets(*shingles(w, SHINGLE), hi - lo)
            size = np.diff(first)
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h, 31))])
            node = mix(total[first[1:]] - total[first[:-1]], 33) ^ mix(size.astype(np.uint64), 35)
            sig = signatures(h, first)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array(node.view(np.int64)), pa.array(size.astype(np.int32)),
                 pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "node", "n", "sig"])


def _forest(link: np.ndarray) -> np.ndarray:
    """Smallest place of the component of each place, of a symmetric matrix of links."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(label)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(node: np.ndarray, n: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the likely pairs of a bucket."""
    g = len(node)
    alike = np.zeros((g, g), np.int16)
    if g <= 64:
        alike = (sig[:, None, :] == sig[None, :, :]).sum(2)
    else:
        for k in range(PLACES):
            alike += sig[:, k][:, None] == sig[:, k][None, :]
    link = (alike >= LIKELY * PLACES) & _sizes_fit(n[:, None], n[None, :])
    label = _forest(link)
    away = np.flatnonzero(label != np.arange(g))
    return node[label[away]], node[away]


def _sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return THRESHOLD[1] * np.minimum(a, b).astype(np.int64) >= THRESHOLD[0] * np.maximum(a, b)


def _children(key: int, sig: np.ndarray) -> list[np.ndarray]:
    """The next keys of a path's sets: one place, or two for one path in four."""
    pick = mix(np.array([key, key + 1, key + 2], np.int64).view(np.uint64), 41)
    out = []
    for i in range(2 if pick[2] % np.uint64(4) == 0 else 1):
        place = int(pick[i] % np.uint64(PLACES))
        out.append(mix(mix(np.array([key], np.int64).view(np.uint64), 43 + i) + sig[:, place].astype(np.uint64), 47).view(np.int64))
    return out


def _bucket_rows(kind: int, key, node, other=None, n=None, sig=None) -> pa.RecordBatch:
    m = len(node)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(m, kind, np.int32)), pa.array(key if key is not None else np.zeros(m, np.int64)), pa.array(node),
        pa.array(other if other is not None else np.zeros(m, np.int64)), pa.array(n if n is not None else np.zeros(m, np.int32)),
        pa.array([x.tobytes() for x in sig] if sig is not None else [b""] * m, pa.binary())],
        names=["kind", "key", "node", "other", "n", "sig"])


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """True at the first place of each different tuple of the keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out


def _new_links(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges between nodes of these tags link two tags that no edge before them did."""
    return _first_of(np.minimum(a, b), np.maximum(a, b)) & (a != b)


def _pivots(node: np.ndarray, sig: np.ndarray, tag: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray]:
    """(nodes, signatures, group of each, tags) of a large bucket's pivots, and edges that span their groups."""
    pick, left = [], np.arange(len(node))
    while len(pick) < PIVOTS and len(left):
        pick.append(left[0])
        left = left[(sig[left] == sig[left[0]]).mean(1) < ALIKE]
    near = (sig[pick][:, None, :] == sig[pick][None, :, :]).sum(2) >= NEAR * PLACES - 1e-9
    group = _forest(near)
    away = np.flatnonzero(group != np.arange(len(pick)))
    return (node[pick], sig[pick], group, tag[pick]), node[pick][group[away]], node[pick][away]


def _settle(pivots: tuple, node: np.ndarray, sig: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges to the pivots (one for each tag), which rows go on, and a name for what each row is linked to by now."""
    pn, ps, group, pt = pivots
    alike = np.stack([(sig == s).sum(1) for s in ps], 1)
    near = alike >= NEAR * PLACES - 1e-9
    near[pn[None, :] == node[:, None]] = False
    a, b = [], []
    while True:                         # a node of several groups joins them: they are one from here on
        first = np.where(near, group[None, :], len(group)).min(1)
        more = np.flatnonzero((near & (group[None, :] != first[:, None])).any(1))
        if not len(more):
            break
        mine = near[more[0]]
        own = np.unique(group[mine])
        a += [pn[np.flatnonzero(mine & (group == g))[0]] for g in own]
        b += [node[more[0]]] * len(own)
        group[np.isin(group, own)] = own[0]
    some = np.flatnonzero(near.any(1))  # pivots of a group are linked already: one edge to it will do
    mine = group[near[some].argmax(1)]
    new = _first_of(mine, tag[some]) & (tag[some] != pt[mine])
    a = np.concatenate([np.array(a, np.int64), pn[mine[new]]])
    b = np.concatenate([np.array(b, np.int64), node[some[new]]])
    go = (alike < ALIKE * PLACES).all(1) | np.isin(node, pn)
    name = tag.copy()
    name[some] = pn[mine]
    self_ = pn[None, :] == node[:, None]
    own = np.flatnonzero(self_.any(1))
    name[own] = pn[group[self_[own].argmax(1)]]
    return a, b, go, name


def _split(last: bool, most: int, hold: int | None = None, level: int = 1, depth: int = 1):
    """Rows (key, node, n, sig, tag) in order of key: edges (kind 0) of small buckets, next rows (kind 1) of very large ones.

    A bucket of more than ``most`` and at most ``hold`` rows is split on to the end where it is. Of a larger
    one, ``other`` of a next row names the group of pivots it is linked to (itself if none). What is left of a large
    bucket at the last level (kind 3, in a task at the last level itself 1) keeps its key, and ``other`` is the number of
    its block. A row of kind 2 says in ``other`` how deep a task went. Nodes of one tag are linked already: without
    the column each node is its own.
    """
    hold = most if hold is None else hold

    def split(at: int, key: int, node, n, sig, tag, deepest: list[int]) -> Iterator[pa.RecordBatch]:
        if (tag == tag[0]).all():
            return
        deepest[0] = max(deepest[0], at)
        if len(node) <= most:
            a, b = _compare(np.arange(len(node)), n, sig)
            new = _new_links(tag[a], tag[b])
            if new.any():
                yield _bucket_rows(0, None, node[a[new]], node[b[new]])
            return
        pivots, a, b = _pivots(node, sig, tag)
        x, y, go, name = _settle(pivots, node, sig, tag)
        a, b = np.concatenate([a, x]), np.concatenate([b, y])
        if len(a):
            yield _bucket_rows(0, None, a, b)
        if at == depth:
            block = np.arange(int(go.sum())) // most
            yield _bucket_rows(3, np.full(len(block), key, np.int64), node[go], block, n[go], sig[go])
            return
        node, n, sig, name = node[go], n[go], sig[go], name[go]
        for child in _children(key, sig):
            if not len(child):
                continue
            order = np.argsort(child, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], child[order][1:] != child[order][:-1]]))
            end = np.append(cut[1:], len(order))
            own = name[order]
            several = np.minimum.reduceat(own, cut) != np.maximum.reduceat(own, cut)      # rows of one group are linked already
            for lo, hi in zip(cut[several].tolist(), end[several].tolist()):
                i = order[lo:hi]
                yield from split(at + 1, int(child[i[0]]), node[i], n[i], sig[i], name[i], deepest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []          # the open bucket's rows, hold and a batch at most
        open_key: int | None = None
        pivots: tuple | None = None     # set once the open bucket is very large
        gone = 0                        # rows of the open bucket that went on
        deepest = [level]

        def pass_on(key, node, n, sig, tag):
            nonlocal gone
            a, b, go, name = _settle(pivots, node, sig, tag)
            if len(a):
                yield _bucket_rows(0, None, a, b)
            if not go.any():
                return
            if last:
                block = (gone + np.arange(int(go.sum()))) // most
                yield _bucket_rows(1, np.full(len(block), key, np.int64), node[go], block, n[go], sig[go])
            else:
                for child in _children(key, sig[go]):
                    yield _bucket_rows(1, child, node[go], name[go], n[go], sig[go])
            gone += int(go.sum())

        def close():
            nonlocal held, pivots, gone
            if pivots is None and sum(len(h[0]) for h in held) > 1:
                yield from split(level, open_key, *(np.concatenate(x) for x in zip(*held)), deepest)
            held, pivots, gone = [], None, 0

        for batch in batches:
            key, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            n = np.asarray(batch.column(2))
            if not len(key):
                continue
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(-1, PLACES)
            tag = np.asarray(batch.column(4)) if batch.num_columns > 4 else node
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.append(cut[1:], len(key))
            alone = end - cut == 1
            for i, (a, z) in enumerate(zip(cut.tolist(), end.tolist())):
                if open_key is None or key[a] != open_key:
                    if held or pivots is not None:
                        yield from close()
                    open_key = int(key[a])
                    if alone[i] and i < len(cut) - 1:
                        continue
                part = (node[a:z], n[a:z], sig[a:z], tag[a:z])
                if pivots is not None:
                    yield from pass_on(open_key, *part)
                    continue
                held.append(part)
                if sum(len(h[0]) for h in held) > hold:
                    hn, hz, hs, ht = (np.concatenate(x) for x in zip(*held))
                    pivots, x, y = _pivots(hn, hs, ht)
                    held = []
                    if len(x):
                        yield _bucket_rows(0, None, x, y)
                    yield from pass_on(open_key, hn, hz, hs, ht)
        yield from close()
        if deepest[0] > level:
            yield _bucket_rows(2, None, np.zeros(1, np.int64), np.array(deepest, np.int64))
    return run


def _block_edges(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that span the likely pairs of large buckets (key, block, node, n, sig): a task's unit is a pair of blocks."""
    parts = partitions(rows.sparkSession)
    cut = rows.join(rows.groupBy("key").agg((F.max("block") + 1).alias("blocks")), "key")
    dealt = cut.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "key", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "node", "n", "sig")
    return dealt.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y", "block", "node").mapInArrow(_compare_blocks, "a long, b long")


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, x, y, block, node, n, sig) in order of (key, x, y): edges of each pair of blocks."""
    held: list[tuple] = []              # a pair of blocks
    at = None

    def close():
        if not held:
            return
        block, node, n, sig = (np.concatenate(x) for x in zip(*held))
        if at[1] != at[2] and len(np.unique(block)) < 2 or len(node) < 2:
            return
        a, b = _compare(node, n, sig)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, x, y, block, node, n = (np.asarray(batch.column(i)) for i in range(6))
        sig = np.frombuffer(b"".join(batch.column(6).to_pylist()), "<u2").reshape(-1, PLACES)
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        for i, j in zip(cut.tolist(), np.append(cut[1:], len(key)).tolist()):
            here = (int(key[i]), int(x[i]), int(y[i]))
            if here != at:
                yield from close()
                held, at = [], here
            held.append((block[i:j], node[i:j], n[i:j], sig[i:j]))
    yield from close()


def recall(runs: int, depth: int) -> float:
    """The chance that a pair at the threshold is found by so many runs whose buckets are compared at this depth.

    The pair shares a binomial number of the places, the same for all runs; a path splits by a shared
    place with that share, and has two children for one path in four.
    """
    s = THRESHOLD[0] / THRESHOLD[1]
    out = 0.0
    for m in range(math.ceil(LIKELY * PLACES), PLACES + 1):
        kept = 1.0
        for _ in range(depth - 1):
            kept = 0.75 * m / PLACES * kept + 0.25 * (1 - (1 - m / PLACES * kept) ** 2)
        out += math.comb(PLACES, m) * s ** m * (1 - s) ** (PLACES - m) * (1 - (1 - m / PLACES * kept) ** runs)
    return out


def runs_needed(target: float, depth: int, most: int = 1024) -> int:
    """The least number of runs whose recall at this depth reaches the target."""
    for runs in range(1, most + 1):
        if recall(runs, depth) >= target:
            return runs
    raise ValueError(f"a recall of {target} is out of reach at depth {depth}: {most} runs give {recall(most, depth):.6f}")


def _likely_edges(nodes: DataFrame, depth: int, target: float) -> DataFrame:
    """Edges (a, b) that span all pairs the runs find; runs are added until the target recall holds at the depth reached."""
    edges, done, deepest, todo = None, 0, 1, RUNS
    while done < todo:
        stop = todo if done else 1
        found, reached = _run_edges(nodes, done, stop, depth)
        edges = found if edges is None else edges.union(found)
        if not done:
            nodes = _tagged(nodes, found)
        done, deepest = stop, max(deepest, reached)
        todo = max(done, RUNS, runs_needed(target, deepest))
    return edges


def _tagged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with a ``tag``: the least node that these edges link each to (itself if none does). One tag, one component."""
    to = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("tag"))
    return nodes.join(to, "node", "left").withColumn("tag", F.coalesce("tag", "node"))


def _run_edges(nodes: DataFrame, first: int, stop: int, depth: int) -> tuple[DataFrame, int]:
    """Edges (a, b) of the runs from first to before stop, and the deepest level that had rows."""
    spark = nodes.sparkSession
    parts = partitions(spark)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.argsort(mix(np.arange(PLACES, dtype=np.uint64), 51))
        order = [(r, places[r % PLACES]) for r in range(first, stop)]      # a place used again starts other paths
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u2").reshape(-1, PLACES)
            for r, place in order:
                key = mix(mix(np.array([r], np.uint64), 53) + sig[:, place].astype(np.uint64), 57).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], names=["key", "node", "n", "sig", "tag"])

    row = "key long, node long, n int, sig binary, tag long"
    tag = F.col("tag" if "tag" in nodes.columns else "node").alias("tag")
    rows = nodes.where("n > 0").select("node", "n", "sig", tag).mapInArrow(roots, row)
    edges, reached = None, 1
    for level in range(1, depth + 1):
        dealt = rows.repartition(parts, "key").sortWithinPartitions("key", "node")
        got = written(dealt.mapInArrow(_split(level == depth, BUCKET, max(HOLD, BUCKET), level, depth), "kind int, key long, node long, other long, n int, sig binary"), f"paths{level}")
        found = got.where("kind = 0").select(F.col("node").alias("a"), F.col("other").alias("b"))
        edges = found if edges is None else edges.union(found)
        reached = max(reached, level, got.where("kind = 2").agg(F.max("other")).first()[0] or 0)
        left = got.where("kind = 1 or kind = 3" if level == depth else "kind = 3").select("key", F.col("other").alias("block"), "node", "n", "sig")
        if left.take(1):
            edges = edges.union(written(_block_edges(left), "blocks"))
        if level == depth:
            break
        rows = got.where("kind = 1").select("key", "node", "n", "sig", "other")
        # rows that are linked to one group of pivots need not meet again
        several = rows.groupBy("key").agg(F.min("other").alias("a"), F.max("other").alias("z")).where("a <> z").select("key")
        rows = rows.join(several, "key", "left_semi").select("key", "node", "n", "sig", F.col("other").alias("tag"))
        if not rows.take(1):
            break
    return edges, reached


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common tokens of all pairs of a block, by matrix products over parts of the vocabulary."""
    g = len(sets)
    flat = np.concatenate(sets) if g else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    word = np.cumsum(new) - 1
    shared = np.bincount(word)[word] > 1 if len(word) else np.zeros(0, bool)
    word, owner = word[shared], owner[shared]
    out = np.zeros((g, g), np.float32)
    if not len(word):
        return out.astype(np.int64)
    word = np.cumsum(np.concatenate([[True], word[1:] != word[:-1]])) - 1
    for lo in range(0, int(word[-1]) + 1, 4096):
        a, z = np.searchsorted(word, [lo, lo + 4096])
        m = np.zeros((g, 4096), np.float32)
        m[owner[a:z], word[a:z] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (component, x, y): per node its number of links, and edges that span the true links."""
    held: list[tuple] = []
    at = None

    def close():
        if len(held) < 2:
            return
        x, y = at[1], at[2]
        node = np.array([h[0] for h in held], np.int64)
        mine = np.array([h[1] for h in held])
        copies = np.array([h[2] for h in held], np.int64)
        sets = [h[3] for h in held]
        both = _common(sets)
        n = np.array([len(s) for s in sets], np.int64)
        p, q = THRESHOLD
        link = (p + q) * both >= p * (n[:, None] + n[None, :])
        if x != y:                      # pairs within a block are another task's
            link &= mine[:, None] != mine[None, :]
        np.fill_diagonal(link, False)
        links = (link * copies[None, :]).sum(1)
        label = _forest(link)
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]), pa.array(links[some])],
                                         names=["node", "other", "links"])

    for b in batches:
        for r in zip(*[b.column(i).to_pylist() for i in range(7)]):
            here = (r[0], r[1], r[2])
            if here != at:
                yield from close()
                held, at = [], here
            held.append((r[3], r[4], r[5], np.frombuffer(r[6], "<u8")))
    yield from close()


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 8,
                    target: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links for every row: documents linked by similarities of 0.8 or more.

    class_id is the smallest doc_id of the connected class, n_links the number of other rows with a
    similarity of 0.8 or more (copies count as links). Texts without words are copies of each other.
    Repeated rows count as copies. A row without an id has no class (null) and 0 links. Other columns
    are ignored. Runs are added until a pair of similarity 0.8 is found with the chance ``target``,
    reckoned for the deepest level that had rows (``depth`` at most). Levels, edges and sets are written to the shared folder.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = partitions(docs.sparkSession)
    mine = written(src.where("doc_id is not null").mapInArrow(_nodes, _NODE), "nodes")
    reps = mine.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"),
                                    F.first("n").alias("n"), F.first("sig").alias("sig"))
    comps = connected_components(_likely_edges(reps, depth, target))
    sized = comps.join(comps.groupBy("component").agg(F.count("*").alias("size")), "component")
    todo = sized.join(reps.select("node", "rep", "copies"), "node")
    # a repeated id may stand for several texts: the node tells which row is meant
    texts = src.where("doc_id is not null").join(todo.withColumnRenamed("rep", "doc_id"), "doc_id")
    sets = texts.select("node", "component", "copies", "size", "text").mapInArrow(
        _sets_of_node, "node long, component long, copies long, size long, tokens binary").dropDuplicates(["node"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = sets.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("mine", "o").alias("x"), F.greatest("mine", "o").alias("y"), "node", "mine", "copies", "tokens")
    checked = written(dealt.repartition(parts, "component", "x", "y").sortWithinPartitions("component", "x", "y", "node")
                      .mapInArrow(_verify, "node long, other long, links long"), "links")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(checked.select(F.col("other").alias("a"), F.col("node").alias("b")))
    info = reps.select("node", "rep", "copies").join(classes, "node", "left").join(links, "node", "left")
    info = info.withColumn("component", F.coalesce("component", "node"))
    least = info.groupBy("component").agg(F.min("rep").alias("class_id"))
    info = info.join(least, "component").select("node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = mine.select("doc_id", "node").join(info, "node").select("doc_id", "class_id", "n_links")
    return out.union(src.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def _sets_of_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component, copies, size, text) to whole shingle sets, without rows whose text is not the node's (repeated ids)."""
    table_ = alnum_table()
    for b in batches:
        for lo, hi, w in word_batches(b.column(4), table_, SLICE_BYTES):
            h, first = token_sets(*shingles(w, SHINGLE), hi - lo)
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h, 31))])
            node = mix(total[first[1:]] - total[first[:-1]], 33) ^ mix(np.diff(first).astype(np.uint64), 35)
            right = np.flatnonzero(node.view(np.int64) == np.asarray(b.column(0).slice(lo, hi - lo)))
            tokens = [h[first[i]:first[i + 1]].astype("<u8").tobytes() for i in right]
            take = pa.array(right + lo)
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(take) for i in range(4)], pa.array(tokens, pa.binary())],
                                             names=["node", "component", "copies", "size", "tokens"])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
