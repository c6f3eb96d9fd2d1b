"""Ghost removal against a plain sequential greedy loop (brute force) on small fixtures."""

import math
import os
import random
from collections import Counter
from datetime import date
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from txnclean import ColumnMapping, GhostOptions, clean
from txnclean.functions.similarity import overlap, prefix_of, text_tokens
from txnclean.plans.clean_job import clean_csv

from conftest import DATA


def brute_force(rows, tol, dtol, thr, text=True):
    """rows: (date_iso|None, text|None, amount|None) in arrival order -> kept indexes."""
    kept = []
    for i, (d, t, a) in enumerate(rows):
        hit = False
        for k in kept:
            d2, t2, a2 = rows[k]
            if a is not None and a2 is not None and abs(a - a2) > tol:
                continue
            if d and d2 and abs((date.fromisoformat(d) - date.fromisoformat(d2)).days) > dtol:
                continue
            if text and SequenceMatcher(None, (t or "").strip().lower(),
                                        (t2 or "").strip().lower()).ratio() < thr:
                continue
            hit = True
            break
        if not hit:
            kept.append(i)
    return kept


def run_spark(spark, rows, tol, dtol, thr, header=("date", "description", "amount")):
    df = spark.createDataFrame(
        [(i, d, t, None if a is None else repr(a)) for i, (d, t, a) in enumerate(rows)],
        f"i long, `{header[0]}` string, `{header[1]}` string, `{header[2]}` string")
    res = clean(df.repartition(3), ColumnMapping(date_columns=[header[0]], amount_columns=[header[2]],
                                                 output_columns=list(header)),
                order_by="i", ghosts=GhostOptions(True, thr, tol, dtol))
    # dedupe runs first in the job, so compare on rows that survive it
    return sorted(r["_ord"]["i"] for r in res.cleaned.collect()), res


WORDS = ["coffee shop", "coffee shops", "coffe shop", "book store", "bookstore", "taxi", "taxi ride",
         "", "uber", "uber ride", "groceries", "grocery"]


def random_rows(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        d = None if rnd.random() < 0.1 else f"2026-04-{rnd.randint(10, 14):02d}"
        a = None if rnd.random() < 0.1 else rnd.choice([10.0, 10.004, 10.01, 10.02, 10.03, 11.0, 0.0])
        t = rnd.choice(WORDS) + (" x" * rnd.randint(0, 1))
        rows.append((d, t, a))
    return rows


def unique_rows(rows):
    """Rows kept by exact dedupe on (date, text key, amount to 2 places), in order."""
    seen, out = set(), []
    for i, (d, t, a) in enumerate(rows):
        k = (d or "", " ".join((t or "").split()).lower(), "" if a is None else f"{round(a, 2):.2f}")
        if k not in seen:
            seen.add(k)
            out.append(i)
    return out


@pytest.mark.parametrize("seed,tol,dtol,thr", [(1, 0.01, 0, 0.9), (2, 0.02, 1, 0.8), (3, 0.0, 2, 0.6),
                                               (4, 0.05, 0, 0.95), (5, 0.01, 3, 0.5)])
def test_matches_greedy_loop(spark, seed, tol, dtol, thr):
    rows = random_rows(seed, 120)
    keep = unique_rows(rows)
    sub = [rows[i] for i in keep]
    expected = sorted(keep[k] for k in brute_force(sub, tol, dtol, thr))
    got, _ = run_spark(spark, rows, tol, dtol, thr)
    assert got == expected


@pytest.mark.parametrize("seed,tol,dtol", [(7, 0.01, 0), (8, 0.02, 2)])
def test_without_text_column(spark, seed, tol, dtol):
    rows = random_rows(seed, 150)
    keep = unique_rows(rows)
    sub = [rows[i] for i in keep]
    expected = sorted(keep[k] for k in brute_force(sub, tol, dtol, 0.9, text=False))
    got, _ = run_spark(spark, rows, tol, dtol, 0.9, header=("date", "note", "amount"))
    assert got == expected


CASES = [  # earlier row, later row, later is ghost (FIXTURES.md, ghost cases)
    ((("2026-04-16", "coffee shop", 10.0)), ("2026-04-16", "coffee shops", 10.0), True),
    ((("2026-04-16", "coffee shop", 1.0)), ("2026-04-16", "coffee shop", 1.01), False),
    ((("2026-04-16", "coffee shop", 10.0)), ("2026-04-17", "coffee shop", 10.0), False),
    (((None, "coffee shop", 10.0)), ("2026-04-17", "coffee shops", 10.0), True),
    ((("2026-04-16", "coffee shop", None)), ("2026-04-16", "coffee shops", 99.0), True),
]


@pytest.mark.parametrize("first,second,ghost", CASES)
def test_fixture_pairs(spark, first, second, ghost):
    got, _ = run_spark(spark, [first, second], 0.01, 0, 0.9)
    assert got == ([0] if ghost else [0, 1])


def test_not_transitive(spark):
    rows = [("2026-04-16", "x", 10.0), ("2026-04-16", "x", 10.008), ("2026-04-16", "x", 10.016)]
    got, res = run_spark(spark, rows, 0.01, 0, 0.9)
    assert got == [0, 2]
    assert res.stats().collect()[0].ghost_transactions_removed == 1


def test_golden_large_with_ghosts(spark, scratch):
    out = os.path.join(scratch, "o")
    stats = clean_csv(spark, os.path.join(DATA, "messy_financial_data_large.csv"), out,
                      ghosts=GhostOptions(enabled=True), single_file=True)
    assert stats["total_rows_cleaned"] == 23 and stats["ghost_transactions_removed"] == 5
    import csv
    import glob
    rows = list(csv.reader(open(glob.glob(os.path.join(out, "part-*"))[0], encoding="utf-8")))
    with open(os.path.join(DATA, "cleaned_transactions.csv"), encoding="utf-8") as f:
        full = list(csv.reader(f))
    removed = [r for r in full[1:] if r not in rows[1:]]
    assert removed == [["2026-04-16", "ELECTRICITY BILL", "800"], ["2026-04-20", "Book Store", ""],
                       ["2026-04-22", "random entry", ""], ["2026-04-25", "UNKNOWN", "350"],
                       ["2026-04-28", "Random Text", "250"]]


def sparse_rows(seed, n):
    """Many NULL dates / amounts and empty texts: exercises the class rule in text mode."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        d = None if rnd.random() < 0.4 else f"2026-04-{rnd.randint(10, 12):02d}"
        a = None if rnd.random() < 0.4 else rnd.choice([5.0, 5.01, 7.0, 9.5])
        t = rnd.choice(["", "", "", "coffee shop", "coffee shops", "taxi", None])
        t = t if t is not None else ""
        rows.append((d, t, a))
    return rows


@pytest.mark.parametrize("seed,dtol", [(11, 0), (12, 1)])
def test_sparse_rows_with_text(spark, seed, dtol):
    rows = sparse_rows(seed, 120)
    keep = unique_rows(rows)
    sub = [rows[i] for i in keep]
    expected = sorted(keep[k] for k in brute_force(sub, 0.01, dtol, 0.9))
    got, _ = run_spark(spark, rows, 0.01, dtol, 0.9)
    assert got == expected


def test_ignored_text_column_is_void(spark):
    rows = [("2026-04-16", "coffee", 10.0), ("2026-04-16", "tea", None), ("2026-04-17", "tea", 3.0)]
    df = spark.createDataFrame([(i, d, t, repr(a) if a is not None else None) for i, (d, t, a) in enumerate(rows)],
                               "i long, date string, description string, amount string")
    res = clean(df, ColumnMapping(date_columns=["date"], amount_columns=["amount"],
                                  ignore_columns=["description"], output_columns=["date", "description", "amount"]),
                order_by="i", ghosts=GhostOptions(True))
    # description ignored -> every text is empty (ratio 1) -> row 1 (same day, no amount) is a ghost;
    # with the text compared, "tea" vs "coffee" would keep it
    assert sorted(r["_ord"]["i"] for r in res.cleaned.collect()) == [0, 2]


def test_metrics_and_max_rounds(spark):
    # a chain: each amount within tolerance of the previous one only (distinct 2-place keys)
    rows = [("2026-04-16", "x", a) for a in (10.0, 10.01, 10.02, 10.03, 10.04, 10.05)]
    got, res = run_spark(spark, rows, 0.015, 0, 0.9)
    assert got == [0, 2, 4]
    m = res.ghost_metrics
    assert m["rows"] == 6 and m["collapsed_rows"] == 6 and m["candidate_edges"] == 5 and m["rounds"] >= 2
    df = spark.createDataFrame([(i, d, t, repr(a)) for i, (d, t, a) in enumerate(rows)],
                               "i long, date string, description string, amount string")
    with pytest.raises(RuntimeError):
        clean(df, order_by="i", ghosts=GhostOptions(True, amount_tol=0.015, max_rounds=1))


def test_rounds_carry_undecided_rows_only(spark):
    rows = [("2026-04-16", "x", 10.0 + i / 100) for i in range(8)] + [("2026-05-01", "x", float(i)) for i in range(40)]
    got, res = run_spark(spark, rows, 0.015, 0, 0.9)
    assert got == [0, 2, 4, 6] + list(range(8, 48))
    # every round settles a link; rows without a neighbour leave in the first
    assert res.ghost_metrics["round_sizes"] == [(48, 7), (6, 5), (4, 3), (2, 1)]


def test_text_tokens(spark):
    texts = ["", "aab", "caf\u00e9 \U0001d4b3\U0001d4b3", "vendor 1221", "a" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("k", text_tokens(F.col("t")))
    rows = df.withColumn("p", prefix_of(F.col("k"), 0.9)).collect()
    for r in rows:
        assert len(r["k"]) == len(set(r["k"])) == len(r["t"]) and r["k"] == sorted(r["k"])
        need = math.ceil(0.9 * len(r["t"]) / 1.1 - 1e-9)
        assert r["p"] == (r["k"][:len(r["t"]) - need + 1] if r["t"] else [0])
    both = df.alias("a").crossJoin(df.alias("b")).select(
        F.col("a.t").alias("x"), F.col("b.t").alias("y"), overlap("a.k", "b.k").alias("n"))
    for r in both.collect():
        assert r["n"] == sum((Counter(r["x"]) & Counter(r["y"])).values())


def test_text_alone_tests_few_pairs(spark):
    """Rows with neither date nor amount: what the ratio is computed for stays a small share of all pairs."""
    from txnclean.operators.ghosts import NN, RID, _pairs
    rnd = random.Random(5)
    rows = [(i, " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4))) for i in range(1000)]
    rows += [(1000 + i, t + "s") for i, t in rows]
    r = (spark.createDataFrame(rows, f"`{RID}` long, tx string")
         .withColumn("cls", F.lit(NN)).withColumn("dn", F.lit(None).cast("int")).withColumn("am", F.lit(None).cast("double"))
         .withColumn("toks", text_tokens(F.col("tx"))).withColumn("prefix", prefix_of(F.col("toks"), 0.9)))
    pairs = [(p["i"], p["j"]) for p in _pairs(r, r, False, False, 0.9, 0.0, 0).select("i", "j").collect()]
    assert len(pairs) == len(set(pairs)) and {(1000 + i, i) for i in range(1000)} <= set(pairs)
    assert len(pairs) < 0.02 * 2000 * 1999 / 2


def greedy_amounts(rows, tol, dtol):
    """The sequential rule for rows (day, amount), fast: kept amounts by day in a sorted list."""
    import bisect
    kept, out = {}, []
    for i, (d, a) in enumerate(rows):
        hit = False
        for x in range(d - dtol, d + dtol + 1):
            line = kept.get(x, [])
            at = bisect.bisect_left(line, a)
            hit = hit or any(abs(line[k] - a) <= tol for k in (at - 1, at, at + 1) if 0 <= k < len(line))
        if not hit:
            bisect.insort(kept.setdefault(d, []), a)
            out.append(i)
    return out


def run_amounts(spark, rows, tol, dtol, **opts):
    from txnclean.operators.ghosts import GHOST, flag_ghosts
    from txnclean.plans.clean_job import ghost_columns
    from txnclean.plans.roles import resolve_roles

    df = spark.createDataFrame([(i, str(date.fromordinal(738000 + d)), a) for i, (d, a) in enumerate(rows)], "_ord long, date string, amount double")
    roles, metrics = resolve_roles(["date", "amount"], None), {}
    out = flag_ghosts(df, roles, ghost_columns(roles), GhostOptions(True, 0.9, tol, dtol, **opts), metrics=metrics)
    return sorted(r["_ord"] for r in out.where(~F.col(GHOST)).select("_ord").collect()), metrics


def test_long_chain_settles_in_few_rounds(spark):
    rows = [(1, 10.0 + 0.008 * i) for i in range(2000)]
    got, metrics = run_amounts(spark, rows, 0.01, 0)
    assert got == greedy_amounts(rows, 0.01, 0) and metrics["rounds"] <= 3


def test_long_chain_of_texts_settles_in_few_rounds(spark):
    """Explicit edges: each text is like the one before alone."""
    texts, t = [], list("abcdefghijklmnopqrst" * 3)
    for k in range(300):
        t[k % 60] = chr(0x4E00 + k)
        if k % 4 == 3:
            texts.append("".join(t))
    rows = [("2026-04-16", x, 10.0) for x in texts]
    got, res = run_spark(spark, rows, 0.01, 0, 0.9)
    assert got == brute_force(rows, 0.01, 0, 0.9) and res.ghost_metrics["rounds"] <= 3


def test_one_hot_bucket_needs_no_pairs(spark):
    rnd = random.Random(3)
    rows = [(1, round(100 + rnd.random() * 0.05, 7)) for _ in range(100_000)]
    got, metrics = run_amounts(spark, rows, 0.01, 0)
    assert got == greedy_amounts(rows, 0.01, 0) and metrics["candidate_edges"] == 0


@pytest.mark.parametrize("seed,tol,dtol", [(1, 0.01, 0), (2, 0.0, 1), (3, 0.5, 2), (4, 1e-9, 0)])
def test_cells_equal_the_greedy_loop(spark, seed, tol, dtol, monkeypatch):
    import txnclean.operators.ghosts as ghosts
    rnd = random.Random(seed)
    rows = [(rnd.randrange(4), rnd.choice([-3.0, 0.0, 5.0, 1e6, 1e15]) + rnd.randrange(60) * (tol / 3 or 0.25)) for _ in range(1500)]
    want = greedy_amounts(rows, tol, dtol)
    assert run_amounts(spark, rows, tol, dtol)[0] == want
    monkeypatch.setattr(ghosts, "COMPONENT", 40)          # most components are too large for one task
    assert run_amounts(spark, rows, tol, dtol)[0] == want


def test_missing_values_beside_cells(spark):
    """Rows without a date or an amount tie cells together, and the class rule decides some of them."""
    rows = sparse_rows(21, 150) + [("2026-04-11", "x", 5.0 + 0.004 * k) for k in range(60)]
    keep = unique_rows(rows)
    expected = sorted(keep[k] for k in brute_force([rows[i] for i in keep], 0.01, 1, 0.9, text=False))
    got, _ = run_spark(spark, rows, 0.01, 1, 0.9, header=("date", "note", "amount"))
    assert got == expected


@pytest.mark.parametrize("seed,tol,dtol,crowd", [(31, 0.02, 0, 64), (32, 0.015, 1, 64), (33, 0.5, 2, 64), (34, 0.0, 1, 64)])
def test_small_blocks_equal_the_greedy_loop(spark, seed, tol, dtol, crowd, monkeypatch):
    from txnclean.operators import bands
    monkeypatch.setattr(bands, "BLOCK", 12)
    rnd = random.Random(seed)
    rows = [(None if rnd.random() < 0.04 else f"2026-04-{rnd.randint(1, 12):02d}", f"n{i}",
             None if rnd.random() < 0.04 else 10 + rnd.randint(0, 160) / 100) for i in range(400)]
    got, res = run_spark(spark, rows, tol, dtol, 0.9, header=("date", "note", "amount"))
    assert got == brute_force(rows, tol, dtol, 0.9, text=False)


def test_chain_through_many_blocks_settles_in_few_rounds(spark, monkeypatch):
    from txnclean.operators import bands, ghosts
    monkeypatch.setattr(bands, "BLOCK", 50)
    monkeypatch.setattr(ghosts, "COMPONENT", 100)
    n = 2000
    rows = spark.range(n).select(F.col("id").alias("i"), F.lit("2026-04-16").alias("date"), F.concat(F.lit("n"), F.col("id")).alias("note"),
                                 F.format_string("%.3f", F.lit(10) + F.col("id") / 100).alias("amount"))
    res = clean(rows, ColumnMapping(date_columns=["date"], amount_columns=["amount"], output_columns=["date", "note", "amount"]),
                order_by="i", ghosts=GhostOptions(True, amount_tol=0.015, max_rounds=3))
    assert sorted(r["_ord"]["i"] for r in res.cleaned.select("_ord").collect()) == list(range(0, n, 2))


def test_only_the_rows_and_what_is_kept_of_them_stay_on_disk(spark, monkeypatch):
    """Nothing is cached, what rounds leave behind is removed when it has been read, and an all-empty row is carried along."""
    from txnclean.operators import bands
    monkeypatch.setattr(bands, "BLOCK", 200)
    n = 3000
    rows = spark.range(n).select(
        F.col("id").alias("i"), F.when(F.col("id") > 1, "2026-04-16").alias("date"), F.when(F.col("id") > 1, F.concat(F.lit("n"), F.col("id"))).alias("note"),
        F.when(F.col("id") > 1, F.format_string("%.3f", F.lit(10) + F.col("id") / 100)).alias("amount"))
    sc = spark.sparkContext
    held = sc._jsc.getPersistentRDDs().size()

    root = sc.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(root))

    def rows_of(folder):
        try:
            return sc._jsc.sc().checkpointFile(f"{root}/{folder}", sc._jvm.scala.reflect.ClassTag.Any()).count()
        except Exception:
            if os.path.exists(f"{root}/{folder}"):
                raise
            return 0            # Spark has removed one that nothing refers to any more

    res = clean(rows, ColumnMapping(date_columns=["date"], amount_columns=["amount"], output_columns=["date", "note", "amount"]),
                order_by="i", ghosts=GhostOptions(True, amount_tol=0.015))
    assert res.cached is None and sc._jsc.getPersistentRDDs().size() == held
    counts = sorted(map(rows_of, set(os.listdir(root)) - before), reverse=True)
    # the n - 2 rows and the one group of empty rows; n / 2 - 1 kept ones; a few rows near borders
    assert counts[0] == n - 1 and sum(counts[1:]) < n / 2 + n / 4
    assert sorted(r["_ord"]["i"] for r in res.cleaned.select("_ord").collect()) == list(range(2, n, 2))
    acc = res.accounting().first()
    assert acc["balanced"] and (acc["all_empty"], acc["ghost_transactions_removed"], acc["total_rows_cleaned"]) == (2, n // 2 - 1, n // 2 - 1)
    assert res.ghost_metrics["rows"] == n - 2
