"""Segments of texts: no similar pair is lost, and texts of one template meet rarely."""

import random
import time
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnclean.functions.segments import Grams, asked, broken, frequent_segments, in_place, index_rows, probe_rows, widths
from txnclean.functions.similarity import similar_udf
from txnclean.operators.ghosts import DA, NN, RID, _segment_pairs, _text_pairs


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], f"`{RID}` long, tx string, dn int, am double")


def pairs_of(spark, texts, threshold):
    df = frame(spark, texts)
    got = _segment_pairs(df, df, [], F.lit(True), threshold, frequent_segments(df, "tx", threshold))
    return [(r["i"], r["j"]) for r in got.collect()]


def changed(rnd, text, n):
    out = list(text)
    for _ in range(n):
        k = rnd.randrange(len(out) + 1)
        if rnd.random() < 0.5 and out:
            out.pop(min(k, len(out) - 1))
        else:
            out.insert(k, rnd.choice("abcxyz 019é🙂"))
    return "".join(out)


@pytest.mark.parametrize("threshold", [0.55, 0.7, 0.8, 0.875, 0.9, 0.97, 1.0])
def test_no_similar_pair_is_lost(spark, threshold):
    rnd = random.Random(int(threshold * 100))
    base = ["".join(rnd.choice("abcdefgh 012é") for _ in range(rnd.randrange(1, 60))) for _ in range(30)]
    texts = base + [changed(rnd, rnd.choice(base), rnd.randrange(0, 8)) for _ in range(120)] + ["aaaa", "aaaaa", "aaaaaa", "a", "b", "ab"]
    texts = sorted({t for t in texts if t}, key=lambda t: (len(t) * 7919) % 101)
    got = pairs_of(spark, texts, threshold)
    assert len(got) == len(set(got)) and all(j < i for i, j in got)
    want = {(i, j) for i in range(len(texts)) for j in range(i) if SequenceMatcher(None, texts[i], texts[j]).ratio() >= threshold}
    assert want <= set(got)


def test_one_template_grows_in_proportion(spark):
    """Texts that share a template and differ in what fills it: pairs that meet grow with the rows."""
    rnd = random.Random(9)
    fill = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(4000)]
    counts = []
    for n in (1000, 2000, 4000):
        texts = [f"payment to {f}" for f in fill[:n]] + [f"payment to {f}s" for f in fill[:n]]
        got = pairs_of(spark, texts, 0.9)
        assert {(n + i, i) for i in range(n)} <= set(got)
        counts.append(len(got))
    assert counts[2] <= 4.5 * counts[0] and counts[2] < 2 * 4000


def test_widths_leave_a_segment():
    for threshold in (0.51, 0.6, 0.75, 0.8, 0.9, 0.95, 1.0):
        for n in range(1, 400):
            own = widths(threshold, n)
            assert own and all(n // w >= broken(threshold, n) + 1 for w in own)
            assert set(own) <= set(asked(threshold, n))


def test_grams_are_equal_for_equal_substrings():
    g = Grams(["abcab", "", "xabc"])
    assert g.of(0, 2)[0] == g.of(0, 2)[3] == g.of(2, 2)[1] and g.of(0, 3)[0] == g.of(2, 3)[1] and len(g.of(1, 1)) == 0
    assert len({int(x) for w in (1, 2, 3, 4) for x in g.of(0, w)}) == 3 + 3 + 3 + 2


def test_similar_udf_equals_ratio(spark):
    rnd = random.Random(4)
    rows = [(changed(rnd, "coffee shop at the corner", k % 12), "coffee shop at the corner") for k in range(300)] + [("", ""), ("a", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    for t in (0.6, 0.9):
        got = df.select("a", "b", similar_udf(t)(F.col("a"), F.col("b")).alias("s")).collect()
        assert all(r["s"] == (SequenceMatcher(None, r["a"], r["b"]).ratio() >= t) for r in got)


def test_hot_blocks_go_by_segments(spark):
    """One day and amount for all rows: the pairs compared are few, and none is lost."""
    rnd = random.Random(6)
    fill = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) for _ in range(800)]
    texts = fill + [f + "s" for f in fill] + [""] * 2
    df = frame(spark, texts).withColumn("dn", F.lit(5)).withColumn("am", F.lit(10.0) + F.col(RID) % 3 * 0.001).withColumn("cls", F.lit(DA))
    got = _text_pairs(df, df, True, True, 0.9, 0.01, 0, lambda: frequent_segments(df, "tx", 0.9)).select("i", "j").collect()
    got = {(r["i"], r["j"]) for r in got}
    assert {(800 + i, i) for i in range(800)} | {(1601, 1600)} <= got and len(got) < 3 * 800


def test_texts_of_chance_ask_with_one_width_and_meet_rarely(spark):
    """Short texts over a small alphabet share many segments: their characters tell them apart before pairs are counted."""
    from txnclean.functions.segments import chosen_widths
    rnd = random.Random(11)
    texts = ["payment " + "".join(rnd.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGH") for _ in range(44)) for _ in range(3000)]
    df = frame(spark, texts)
    frequent = frequent_segments(df, "tx", 0.9)
    used = chosen_widths(df, "tx", 0.9, frequent)
    assert used == {52: [4]}
    x = index_rows(df.select("tx", RID), "tx", 0.9, frequent, used)
    y = probe_rows(df.select("tx", RID), "tx", 0.9, used)
    assert y.count() == 49 * len(texts)
    y = y.select(F.col(RID).alias("j"), F.col("len").alias("len_p"), F.col("pos").alias("pos_p"), F.col("parity").alias("parity_p"), "gram")
    met = x.join(y, "gram").where(F.col("j") < F.col(RID))
    assert met.count() > 400 and met.where(in_place(0.9)).count() < 5


def lower_base64(rnd, n):
    return "payment " + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)).lower()


def test_numbers_of_characters_tell_chance_meetings_apart():
    """Each unmatched character turns one bit at most, and texts of chance differ in far more bits than similar ones may."""
    rnd = random.Random(5)
    texts = [lower_base64(rnd, 44) for _ in range(2000)]
    near = [changed(rnd, t, k % 6) for k, t in enumerate(texts)]
    own, others, nearest = (Grams(t).parity.view(np.uint64) for t in (texts, texts[1:] + texts[:1], near))
    assert (np.bitwise_count(own ^ others) <= 10).sum() <= 2
    assert all(n <= k % 6 for k, n in enumerate(np.bitwise_count(own ^ nearest).tolist()))


def test_parts_find_the_same_pairs(spark, monkeypatch):
    """Index and probes joined in parts: the pairs are those of one part, and similar ones are among them."""
    from txnclean.functions import segments
    rnd = random.Random(21)
    texts = [lower_base64(rnd, 30) for _ in range(150)]
    texts += [changed(rnd, t, 2) for t in texts] + ["", "a"]
    whole = pairs_of(spark, texts, 0.9)
    monkeypatch.setattr(segments, "ROWS", 100)
    assert sorted(pairs_of(spark, texts, 0.9)) == sorted(whole)
    want = {(i, j) for i in range(len(texts)) for j in range(i) if texts[j] and SequenceMatcher(None, texts[i], texts[j]).ratio() >= 0.9}
    assert len(want) > 50 and want <= set(whole)


def test_segments_that_no_text_is_indexed_by_are_not_asked_for(spark):
    from txnclean.functions.segments import surveyed
    rnd = random.Random(8)
    df = frame(spark, [lower_base64(rnd, 44) for _ in range(300)])
    frequent = frequent_segments(df, "tx", 0.9)
    used, idle, rows = surveyed(df, "tx", 0.9, frequent)
    template = {int(h) for h in Grams(["payment "]).of(0, 4)}
    assert used == {52: [4]} and template <= set(idle.tolist())
    x, y = index_rows(df, "tx", 0.9, frequent, used), probe_rows(df, "tx", 0.9, used, idle)
    assert not {r["gram"] for r in x.select("gram").distinct().collect()} & set(idle.tolist())
    assert y.count() <= 44 * 300 and rows == x.count() + 49 * 300
    assert sum(index_rows(df, "tx", 0.9, frequent, used, (k, 3)).count() for k in range(3)) == x.count()


def test_what_is_shuffled_for_a_checkpoint_leaves_the_disk(spark):
    from txnclean.session import CLEANUP, cut_lineage
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        names = [f.getName() for f in (lambda files: [files.apply(k) for k in range(files.size())])(disk.getAllFiles())]
        return {n for n in names if n.startswith("shuffle_")}

    before, set_to = shuffled(), spark.conf.get(CLEANUP, None)
    df = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    kept = cut_lineage(df)
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and spark.conf.get(CLEANUP, None) == set_to
    assert kept.count() == 7 and df.count() == 7 and df.collect()


def test_in_order_bounds_the_ratio_of_texts_that_share_their_characters():
    from txnclean.functions.similarity import _rows_of, in_order

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *(z for z in _step(row, x, b))]
        return row[-1]

    def _step(row, x, b):
        left = 0
        for k, y in enumerate(b):
            left = row[k] + 1 if x == y else max(left, row[k + 1])
            yield left

    rnd = random.Random(4)
    pairs = [("".join(rnd.choice("0123456789 p") for _ in range(rnd.randrange(0, 65))),
              "".join(rnd.choice("0123456789 p") for _ in range(rnd.randrange(0, 65)))) for _ in range(300)]
    pairs += [("p" * 64, "p" * 64), ("", ""), ("12", "21"), ("payment to vendor 17 ref 123456", "payment to vendor 17 ref 654321")]
    tables = []
    for side in zip(*pairs):
        size = np.array([len(t) for t in side])
        codes = np.array([ord(c) & 63 for t in side for c in t], np.int64)
        tables.append(_rows_of(codes, size, np.arange(len(side))))
    got = in_order(*tables)
    assert got.tolist() == [longest(*([ord(c) & 63 for c in t] for t in pair)) for pair in pairs]
    for (a, b), n in zip(pairs, got.tolist()):
        assert SequenceMatcher(None, a, b).ratio() <= (2 * n / (len(a) + len(b)) if a or b else 1.0) + 1e-12
