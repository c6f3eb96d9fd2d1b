"""Messy transaction text derived from the driver's clean ``orders`` table.

The driver's tables are clean, so tests, the bench and the oracle queries derive
messy cells from ``orders`` by a fixed rule on ``o_orderkey`` (k). The same rule is
written twice, as Spark columns and as DuckDB SQL, and the DuckDB side can then
state the *expected* cleaned values from the original columns (no shared parsing).

Per order there are two rows, ``copy`` 0 and 1; arrival order is (copy, k).

* date form (copy 0: k % 7, copy 1: (k + 3) % 7): 0 ``yyyy-MM-dd``, 1 ``dd/MM/yyyy``,
  2 ``yyyy.MM.dd``, 3 ``d Mon yyyy``, 4 ``Month d, yyyy``, 5 ``MM-dd-yyyy`` when the day
  is above 12 else ``dd-MM-yyyy``, 6 ISO with ``T12:30:00Z``. Copy 0 only: k % 53 == 0
  -> ``NaN``, else k % 50 == 0 -> ``31/02/2026``.
* amount form (copy 0: k % 5, copy 1: (k + 2) % 5): 0 ``₹1,234.50``, 1 ``(€1,234.50)``,
  2 ``1234.50 USD``, 3 ``-$1234.50``, 4 ``1234.50``. Copy 0 only: k % 41 == 0 -> empty.
* description: ``<status> order <priority> cust <custkey>``; copy 1 is upper case with
  doubled inner spaces and outer spaces. Copy 0 only: k % 37 == 0 -> a null-like text.
* copy 0 with k % 97 == 0: every cell null-like (the row is dropped as empty).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names used to write dates (calendar order).
MON_SHORT = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MON_FULL = ["January", "February", "March", "April", "May", "June", "July", "August",
            "September", "October", "November", "December"]
# Null-like descriptions, picked by (k / 37) % 5.
NULL_DESCS = ["NULL", " none ", "NaN", "na", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _date_text(d: Column, form: Column) -> Column:
    y, m, dd = F.year(d).cast("string"), F.month(d), F.dayofmonth(d)
    short = F.element_at(F.array(*[F.lit(x) for x in MON_SHORT]), m)
    full = F.element_at(F.array(*[F.lit(x) for x in MON_FULL]), m)
    return (
        F.when(form == 0, F.concat_ws("-", y, _pad2(m), _pad2(dd)))
        .when(form == 1, F.concat_ws("/", _pad2(dd), _pad2(m), y))
        .when(form == 2, F.concat_ws(".", y, _pad2(m), _pad2(dd)))
        .when(form == 3, F.concat_ws(" ", dd.cast("string"), short, y))
        .when(form == 4, F.concat(full, F.lit(" "), dd.cast("string"), F.lit(", "), y))
        .when(form == 5, F.when(dd > 12, F.concat_ws("-", _pad2(m), _pad2(dd), y))
              .otherwise(F.concat_ws("-", _pad2(dd), _pad2(m), y)))
        .otherwise(F.concat(F.concat_ws("-", y, _pad2(m), _pad2(dd)), F.lit("T12:30:00Z")))
    )


def _amount_text(p: Column, form: Column) -> Column:
    plain = F.format_string("%.2f", p)
    grouped = F.format_number(p, 2)
    return (
        F.when(form == 0, F.concat(F.lit("₹"), grouped))
        .when(form == 1, F.concat(F.lit("(€"), grouped, F.lit(")")))
        .when(form == 2, F.concat(plain, F.lit(" USD")))
        .when(form == 3, F.concat(F.lit("-$"), plain))
        .otherwise(plain)
    )


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``copy, o_orderkey, date, description, amount`` (raw text) from ``orders``."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    desc = F.concat_ws(" ", F.col("o_orderstatus"), F.lit("order"),
                       F.lower(F.col("o_orderpriority")), F.lit("cust"),
                       F.col("o_custkey").cast("string"))
    d = F.col("o_orderdate").cast("date")
    p = F.col("o_totalprice")
    empty_row = (k % 97) == 0
    null_desc = F.element_at(F.array(*[F.lit(x) for x in NULL_DESCS]),
                             (F.floor(k / 37) % 5 + 1).cast("int"))
    copy0 = o.select(
        F.lit(0).alias("copy"), k,
        F.when(empty_row, F.lit("nan")).when(k % 53 == 0, F.lit("NaN"))
        .when(k % 50 == 0, F.lit("31/02/2026"))
        .otherwise(_date_text(d, k % 7)).alias("date"),
        F.when(empty_row, F.lit("")).when(k % 37 == 0, null_desc).otherwise(desc).alias("description"),
        F.when(empty_row, F.lit("NULL")).when(k % 41 == 0, F.lit(""))
        .otherwise(_amount_text(p, k % 5)).alias("amount"),
    )
    copy1 = o.select(
        F.lit(1).alias("copy"), k,
        _date_text(d, (k + 3) % 7).alias("date"),
        F.concat(F.lit(" "), F.upper(F.regexp_replace(desc, " ", "  ")), F.lit(" ")).alias("description"),
        _amount_text(p, (k + 2) % 5).alias("amount"),
    )
    return copy0.unionByName(copy1)


def _sql_date_text(d: str, form: str) -> str:
    short = "[" + ", ".join(f"'{x}'" for x in MON_SHORT) + "]"
    full = "[" + ", ".join(f"'{x}'" for x in MON_FULL) + "]"
    y, m, dd = f"CAST(year({d}) AS VARCHAR)", f"month({d})", f"day({d})"
    p2 = lambda e: f"lpad(CAST({e} AS VARCHAR), 2, '0')"
    return f"""CASE {form}
      WHEN 0 THEN {y} || '-' || {p2(m)} || '-' || {p2(dd)}
      WHEN 1 THEN {p2(dd)} || '/' || {p2(m)} || '/' || {y}
      WHEN 2 THEN {y} || '.' || {p2(m)} || '.' || {p2(dd)}
      WHEN 3 THEN CAST({dd} AS VARCHAR) || ' ' || {short}[{m}] || ' ' || {y}
      WHEN 4 THEN {full}[{m}] || ' ' || CAST({dd} AS VARCHAR) || ', ' || {y}
      WHEN 5 THEN CASE WHEN {dd} > 12 THEN {p2(m)} || '-' || {p2(dd)} || '-' || {y}
                       ELSE {p2(dd)} || '-' || {p2(m)} || '-' || {y} END
      ELSE {y} || '-' || {p2(m)} || '-' || {p2(dd)} || 'T12:30:00Z' END"""


def _sql_amount_text(p: str, form: str) -> str:
    plain = f"printf('%.2f', {p})"
    grouped = f"format('{{:,.2f}}', {p})"
    return f"""CASE {form}
      WHEN 0 THEN '₹' || {grouped}
      WHEN 1 THEN '(€' || {grouped} || ')'
      WHEN 2 THEN {plain} || ' USD'
      WHEN 3 THEN '-$' || {plain}
      ELSE {plain} END"""


def messy_orders_sql() -> str:
    """DuckDB twin of :func:`messy_orders`, plus the expected cleaned values.

    Extra columns: ``exp_date`` (ISO text or NULL), ``exp_fixed`` (0/1),
    ``exp_amount`` (double or NULL), ``exp_symbols``, ``exp_desc`` (trimmed or NULL),
    ``empty_row`` (bool).
    """
    nulls = "[" + ", ".join(f"'{x}'" for x in NULL_DESCS) + "]"
    desc = ("o_orderstatus || ' order ' || lower(o_orderpriority) || ' cust ' || "
            "CAST(o_custkey AS VARCHAR)")
    d = "CAST(o_orderdate AS DATE)"
    return f"""
    SELECT 0 AS copy, o_orderkey,
      CASE WHEN o_orderkey % 97 = 0 THEN 'nan' WHEN o_orderkey % 53 = 0 THEN 'NaN'
           WHEN o_orderkey % 50 = 0 THEN '31/02/2026'
           ELSE {_sql_date_text(d, 'o_orderkey % 7')} END AS date,
      CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 37 = 0
           THEN {nulls}[CAST(floor(o_orderkey / 37) AS BIGINT) % 5 + 1] ELSE {desc} END AS description,
      CASE WHEN o_orderkey % 97 = 0 THEN 'NULL' WHEN o_orderkey % 41 = 0 THEN ''
           ELSE {_sql_amount_text('o_totalprice', 'o_orderkey % 5')} END AS amount,
      CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 53 = 0 OR o_orderkey % 50 = 0 THEN NULL
           ELSE strftime({d}, '%Y-%m-%d') END AS exp_date,
      CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 53 = 0 OR o_orderkey % 50 = 0 THEN 0
           WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS exp_fixed,
      CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 41 = 0 THEN NULL
           WHEN o_orderkey % 5 IN (1, 3) THEN -o_totalprice ELSE o_totalprice END AS exp_amount,
      CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 41 = 0 THEN 0
           WHEN o_orderkey % 5 IN (0, 1, 3) THEN 1 ELSE 0 END AS exp_symbols,
      CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 37 = 0 THEN NULL ELSE {desc} END AS exp_desc,
      o_orderkey % 97 = 0 AS empty_row
    FROM orders
    UNION ALL
    SELECT 1 AS copy, o_orderkey,
      {_sql_date_text(d, '(o_orderkey + 3) % 7')} AS date,
      ' ' || upper(replace({desc}, ' ', '  ')) || ' ' AS description,
      {_sql_amount_text('o_totalprice', '(o_orderkey + 2) % 5')} AS amount,
      strftime({d}, '%Y-%m-%d') AS exp_date,
      CASE WHEN (o_orderkey + 3) % 7 = 0 THEN 0 ELSE 1 END AS exp_fixed,
      CASE WHEN (o_orderkey + 2) % 5 IN (1, 3) THEN -o_totalprice ELSE o_totalprice END AS exp_amount,
      CASE WHEN (o_orderkey + 2) % 5 IN (0, 1, 3) THEN 1 ELSE 0 END AS exp_symbols,
      upper(replace({desc}, ' ', '  ')) AS exp_desc,
      false AS empty_row
    FROM orders"""
