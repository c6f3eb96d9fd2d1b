"""End-to-end clean job: golden pairs, CSV edges, stats, accounting, order invariance."""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from txnclean import clean
from txnclean.plans.clean_job import clean_csv
from txnclean.sources.csv_source import read_csv

from conftest import DATA


def read_output(path):
    parts = sorted(glob.glob(os.path.join(path, "part-*")))
    lines = []
    for i, p in enumerate(parts):
        with open(p, encoding="utf-8", newline="") as f:
            rows = list(csv.reader(f))
        lines += rows if i == 0 else rows[1:]
    return lines


def test_two_row_dedupe(spark, scratch):
    inp = os.path.join(scratch, "messy.csv")
    with open(inp, "w", encoding="utf-8") as f:
        f.write('date,description,amount\n16/04/2026,Coffee Shop,"₹1,200.00"\n2026-04-16,coffee shop,1200\n')
    out = os.path.join(scratch, "out")
    stats = clean_csv(spark, inp, out, single_file=True)
    assert stats["duplicates_removed"] == 1 and stats["total_rows_cleaned"] == 1
    assert read_output(out) == [["date", "description", "amount"], ["2026-04-16", "Coffee Shop", "1200"]]


def test_golden_small(spark, scratch):
    out = os.path.join(scratch, "out")
    stats = clean_csv(spark, os.path.join(DATA, "messy_transactions.csv"), out, single_file=True,
                      report_path=os.path.join(scratch, "report.json"), log_dir=os.path.join(scratch, "logs"))
    assert read_output(out) == [
        ["date", "description", "amount"], ["2026-04-16", "Coffee Shop", "1200"],
        ["2026-04-17", "Groceries", "45.5"], ["", "Bad Date", "10"], ["2026-04-18", "Empty Amount", ""]]
    assert {k: stats[k] for k in list(stats)[:6]} == {
        "total_rows_input": 6, "total_rows_cleaned": 4, "duplicates_removed": 2,
        "ghost_transactions_removed": 0, "currency_symbols_found": 2, "invalid_dates_fixed": 3}
    assert list(stats)[6:] == ["date_columns", "amount_columns", "output_columns",
                               "input_csv_path", "output_csv_path"]
    assert stats["date_columns"] == ["date"] and stats["output_columns"] == ["date", "description", "amount"]
    rep = "".join(open(p, encoding="utf-8").read() for p in glob.glob(os.path.join(scratch, "report.json", "part-*")))
    assert '"total_rows_input": 6' in rep and '  "date_columns": [\n    "date"\n  ]' in rep
    events = spark.read.json(os.path.join(scratch, "logs")).select("message").collect()
    assert sorted(r.message for r in events) == ["clean_complete", "clean_start"]


def test_golden_large(spark, scratch):
    out = os.path.join(scratch, "out")
    stats = clean_csv(spark, os.path.join(DATA, "messy_financial_data_large.csv"), out, single_file=True)
    with open(os.path.join(DATA, "cleaned_transactions.csv"), encoding="utf-8", newline="") as f:
        expected = list(csv.reader(f))
    assert read_output(out) == expected
    assert stats["total_rows_input"] == 42 and stats["total_rows_cleaned"] == 28
    assert stats["duplicates_removed"] == 14
    assert stats["currency_symbols_found"] == 36 and stats["invalid_dates_fixed"] == 32


def test_golden_large_multi_part_order(spark, scratch):
    """Same answer, in order, when the sorted output spans several part files."""
    df = read_csv(spark, os.path.join(DATA, "messy_financial_data_large.csv")).repartition(5)
    res = clean(df)
    got = [[r.Date or "", r.Description or "", r.Amount or ""] for r in
           res.csv_frame().orderBy("_ord").collect()]
    with open(os.path.join(DATA, "cleaned_transactions.csv"), encoding="utf-8", newline="") as f:
        assert got == list(csv.reader(f))[1:]


def test_empty_file_raises(spark, scratch):
    p = os.path.join(scratch, "empty.csv")
    open(p, "w").close()
    with pytest.raises(ValueError):
        clean_csv(spark, p, os.path.join(scratch, "o"))


def test_missing_file_raises(spark, scratch):
    with pytest.raises(FileNotFoundError):
        clean_csv(spark, os.path.join(scratch, "nope.csv"), os.path.join(scratch, "o"))


def test_header_only(spark, scratch):
    p = os.path.join(scratch, "h.csv")
    with open(p, "w") as f:
        f.write("date,description,amount\n")
    out = os.path.join(scratch, "o")
    stats = clean_csv(spark, p, out, single_file=True)
    assert stats["total_rows_cleaned"] == 0 and stats["total_rows_input"] == 0
    assert read_output(out)[1:] == []


def test_unclosed_quote(spark, scratch):
    p = os.path.join(scratch, "m.csv")
    with open(p, "w") as f:
        f.write('date,description,amount\n"2026-04-16,Coffee Shop,10\n')
    out = os.path.join(scratch, "o")
    stats = clean_csv(spark, p, out, single_file=True)
    assert stats["total_rows_cleaned"] == 1
    assert read_output(out)[1:] == [["2026-04-16", "", ""]]


def test_duplicate_header_rejected(spark, scratch):
    p = os.path.join(scratch, "d.csv")
    with open(p, "w") as f:
        f.write("date,date,amount\n1,2,3\n")
    with pytest.raises(ValueError):
        clean_csv(spark, p, os.path.join(scratch, "o"))


def test_row_accounting_and_audit(spark):
    df = read_csv(spark, os.path.join(DATA, "messy_financial_data_large.csv"))
    res = clean(df)
    s = res.stats().collect()[0]
    empties = res.groups.filter("__tc_empty").agg(F.sum("__tc_n")).collect()[0][0] or 0
    assert s.total_rows_input == empties + s.duplicates_removed + s.ghost_transactions_removed + s.total_rows_cleaned
    audit = res.audit.orderBy("_ord").collect()
    assert len(audit) == 42 and sum(r.currency_symbols_found for r in audit) == 36
    assert sum(r.date_fixed for r in audit) == 32


def test_project_ignore_and_missing(spark):
    from txnclean import ColumnMapping
    df = read_csv(spark, os.path.join(DATA, "messy_transactions.csv"))
    res = clean(df, ColumnMapping(date_columns=["date"], amount_columns=["amount"],
                                  ignore_columns=["description"],
                                  output_columns=["date", "description", "amount", "missing"]))
    rows = res.csv_frame().orderBy("_ord").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("2026-04-16", None, "1200", None), ("2026-04-17", None, "45.5", None),
        (None, None, "10", None), ("2026-04-18", None, None, None)]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_result_independent_of_partitioning(spark, parts):
    from txnclean.plans.registry import _messy
    base = _messy(spark, "/root/testdata/sf0.001")
    a = clean(base).cleaned
    b = clean(base.repartition(parts)).cleaned
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_audit_lines_golden_small(spark):
    """I2 on the small golden file, read as several partitions (dense index across them)."""
    df = read_csv(spark, os.path.join(DATA, "messy_transactions.csv")).repartition(3)
    lines = [r.line for r in clean(df).audit_lines().orderBy("_ord").collect()]
    assert lines == [
        "[0] 2026-04-16 | Coffee Shop | 1200.0 (date_fixed=1, currency_found=1)",
        "[1] 2026-04-16 | coffee shop | 1200.0 (date_fixed=0, currency_found=0)",
        "[2] 2026-04-17 | Groceries | 45.5 (date_fixed=1, currency_found=1)",
        "[3] 2026-04-17 | Groceries | 45.5 (date_fixed=1, currency_found=0)",
        "[4] None | Bad Date | 10.0 (date_fixed=0, currency_found=0)",
        "[5] 2026-04-18 | Empty Amount | None (date_fixed=0, currency_found=0)",
    ]
