"""Load job (J2): type inference, conversion, JDBC (in-process Derby) and catalog sinks."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from txnclean.operators.sample import infer_sql_types
from txnclean.plans.load_job import load, load_csv
from txnclean.sources.csv_source import read_csv
from txnclean.sources.jdbc_sink import resolve_target

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
CSV = "date,description,amount\n2026-04-16,Coffee Shop,1200\n,Bad Date,10\n2026-04-18,Empty Amount,\n"


def _csv(scratch, text=CSV, name="cleaned.csv"):
    p = os.path.join(scratch, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def _derby():
    return f"jdbc:derby:memory:t{uuid.uuid4().hex[:8]};create=true"


def _read(spark, url, table):
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**DERBY).load()


def test_load_sqlite_like(spark, scratch):
    url = _derby()
    stats = load_csv(spark, _csv(scratch), url, table_name="financial_records", truncate=True,
                     jdbc_properties=DERBY, log_dir=os.path.join(scratch, "logs"))
    assert stats["rows_in_csv"] == 3 and stats["rows_inserted"] == 3
    assert stats["column_types"] == {"date": "DATE", "description": "VARCHAR", "amount": "FLOAT"}
    rows = {r.description: r for r in _read(spark, url, "financial_records").collect()}
    assert len(rows) == 3
    assert str(rows["Coffee Shop"].date) == "2026-04-16" and isinstance(rows["Coffee Shop"].amount, float)
    assert rows["Bad Date"].date is None and rows["Empty Amount"].amount is None
    ev = [r.message for r in spark.read.json(os.path.join(scratch, "logs")).collect()]
    assert sorted(ev) == ["sql_export_complete", "sql_export_start"]


def test_truncate_and_append(spark, scratch):
    url, p = _derby(), _csv(scratch)
    load_csv(spark, p, url, table_name="fr", jdbc_properties=DERBY)
    load_csv(spark, p, url, table_name="fr", truncate=True, jdbc_properties=DERBY)
    assert _read(spark, url, "fr").count() == 3
    load_csv(spark, p, url, table_name="fr", jdbc_properties=DERBY)
    assert _read(spark, url, "fr").count() == 6


def test_catalog_table(spark, scratch):
    p = _csv(scratch)
    name = f"fr_{uuid.uuid4().hex[:6]}"
    load_csv(spark, p, None, table_name=name)
    load_csv(spark, p, None, table_name=name)
    assert spark.table(name).count() == 6
    load_csv(spark, p, None, table_name=name, truncate=True)
    t = spark.table(name)
    assert t.count() == 3 and dict(t.dtypes)["amount"] == "double" and dict(t.dtypes)["date"] == "date"


def test_bad_float_later_raises_before_writing(spark, scratch):
    text = "date,amount\n2026-04-16,1\n" + "".join(f"2026-04-16,{i}\n" for i in range(30)) + "2026-04-17,abc\n"
    url = _derby()
    with pytest.raises(ValueError):
        load_csv(spark, _csv(scratch, text), url, table_name="t", jdbc_properties=DERBY)


def test_type_inference_rules(spark, scratch):
    text = ("posting_date,debit,total,memo,value_date,empty_amount\n"
            "2026-04-16,5,1_000,x,16/04/2026,\n2026-04-17,6,nan,y,2026-04-17,\n")
    df = read_csv(spark, _csv(scratch, text))
    cols = [c for c in df.columns if c != "_ord"]
    types = infer_sql_types(df, cols)
    assert types == {"posting_date": "DATE", "debit": "VARCHAR", "total": "FLOAT", "memo": "VARCHAR",
                     "value_date": "VARCHAR", "empty_amount": "VARCHAR"}


def test_sample_stops_at_first_full_row(spark, scratch):
    # row 1 fills every column, so only row 1 is sampled: later non-dates do not matter
    text = "date,amount\n2026-04-16,10\n16/04/2026,abc\n"
    df = read_csv(spark, _csv(scratch, text))
    assert infer_sql_types(df, ["date", "amount"]) == {"date": "DATE", "amount": "FLOAT"}


def test_target_resolution():
    t = resolve_target("postgresql://u:p%40ss@db.example:5432/fin", "financial_records")
    assert t.url == "jdbc:postgresql://db.example:5432/fin" and t.table == "public.financial_records"
    assert t.properties["user"] == "u" and t.properties["password"] == "p@ss" and t.postgres
    t2 = resolve_target("database.db", "fr")
    assert t2.url == "jdbc:sqlite:database.db" and not t2.postgres


def test_redaction():
    from txnclean.sources.events import redact
    assert redact("postgresql://u:secret@h:5432/db") == "postgresql://u:***@h:5432/db"
    assert redact("jdbc:x://h/db?user=a&password=secret") == "jdbc:x://h/db?user=a&password=***"


def test_summaries():
    from txnclean.plans.clean_job import clean_summary
    from txnclean.plans.load_job import load_summary
    s = clean_summary({"total_rows_input": 6, "total_rows_cleaned": 4, "duplicates_removed": 2,
                       "ghost_transactions_removed": 0, "currency_symbols_found": 2,
                       "invalid_dates_fixed": 3, "date_columns": ["date"], "amount_columns": ["amount"],
                       "output_csv_path": "out"})
    assert "Cleaned rows: 4" in s and "Date columns: date" in s and s.endswith("Output CSV: out")
    t = load_summary({"rows_in_csv": 3, "rows_inserted": 3, "table_name": "fr", "truncate": True,
                      "postgres": False, "column_types": {"date": "DATE", "amount": "FLOAT"}})
    assert "Truncate: true" in t and "Database: SQLite" in t and t.endswith("  - amount: FLOAT")
