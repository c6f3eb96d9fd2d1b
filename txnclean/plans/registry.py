"""Registered queries: one Spark query and one DuckDB oracle per inventory item.

Each Spark query takes ``(spark, sf_dir)`` and reads the driver's tables (whole
tables, no row caps); each oracle is DuckDB SQL over the same tables that states
the expected answer from the original clean columns where it can.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import named, quote_name
from ..functions.amounts import CURRENCY_SYMBOLS
from ..sources.messy import MON_FULL, MON_SHORT, messy_orders, messy_orders_sql
from ..operators.cells import LIVE
from .clean_job import ORD, CleanResult, clean, with_order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


def _dealt(df: DataFrame) -> DataFrame:
    """Dealt out to as many partitions as the session's ``spark.txnclean.inputPartitions`` says (unset: left alone)."""
    n = df.sparkSession.conf.get("spark.txnclean.inputPartitions", None)
    return df.repartition(int(n)) if n else df


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy orders with ``_ord`` = (copy, o_orderkey) and raw cells only."""
    return _dealt(with_order(messy_orders(spark, sf_dir), ["copy", "o_orderkey"]).drop("copy", "o_orderkey"))


def clean_messy(spark: SparkSession, sf_dir: str, **kw) -> CleanResult:
    return clean(_messy(spark, sf_dir), **kw)


def _ids(df: DataFrame) -> list:
    return [F.col(f"{ORD}.copy").alias("copy"), F.col(f"{ORD}.o_orderkey").alias("o_orderkey")]


_MESSY = f"WITH m AS ({messy_orders_sql()})"
# DuckDB: the D1 key from the expected clean values (H1-H3).
_KEYED = _MESSY + """,
k AS (
  SELECT *,
    coalesce(exp_date, '') AS k_date,
    coalesce(lower(regexp_replace(trim(exp_desc), '\\s+', ' ', 'g')), '') AS k_desc,
    coalesce(printf('%.2f', exp_amount), '') AS k_amount
  FROM m WHERE NOT empty_row)"""


_DEDUPED = _KEYED + """,
d AS (
  SELECT * FROM k
  QUALIFY row_number() OVER (PARTITION BY k_date, k_desc, k_amount ORDER BY copy, o_orderkey) = 1)"""


@register("clean_job", _KEYED + """
SELECT copy, o_orderkey, exp_date AS date, exp_desc AS description, exp_amount AS amount
FROM k
QUALIFY row_number() OVER (PARTITION BY k_date, k_desc, k_amount ORDER BY copy, o_orderkey) = 1
""")
def q_clean_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 flagship: cell rules + B6 + first-row-wins dedupe over all messy orders."""
    res = clean_messy(spark, sf_dir)
    return res.cleaned.select(*_ids(res.cleaned), "date", "description", "amount")


# ---------------------------------------------------------------- helpers

def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


def _staged(df: DataFrame, stages_fn, raw: str, out: str, extra: str) -> DataFrame:
    for st in stages_fn(raw, out, extra, "__q_"):
        df = df.withColumns(st)
    return df


def _date_family(spark: SparkSession, sf_dir: str, text_fn) -> DataFrame:
    from ..functions.dates import date_stages
    o = _orders(spark, sf_dir)
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    df = o.select(k, text_fn(k, F.year(d), F.month(d), F.dayofmonth(d), d).alias("raw"))
    return _staged(df, date_stages, "raw", "date", "fixed").select("o_orderkey", "raw", "date", "fixed")


def _amount_family(spark: SparkSession, sf_dir: str, text_fn) -> DataFrame:
    from ..functions.amounts import amount_stages
    o = _orders(spark, sf_dir)
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    df = o.select(k, text_fn(k, p).alias("raw"))
    return _staged(df, amount_stages, "raw", "amount", "symbols").select("o_orderkey", "raw", "amount", "symbols")


def _s(x) -> Column:
    return x.cast("string")


def _p2(x) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


# Weekday names in Sunday-first order (Spark dayofweek 1 = Sunday).
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
CODES = ["USD", "INR", "EUR"]


def _arr(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


_SYMS = list(CURRENCY_SYMBOLS)
_SQL_ORD = "o_orderkey, CAST(o_orderdate AS DATE) AS d, o_totalprice AS p"


def _sql_p2(e: str) -> str:
    return f"lpad(CAST({e} AS VARCHAR), 2, '0')"


def _sql_date_family(raw: str, exp: str, fixed: str) -> str:
    return f"""SELECT o_orderkey, {raw} AS raw, {exp} AS date, {fixed} AS fixed
FROM (SELECT {_SQL_ORD} FROM orders)"""


def _sql_amount_family(raw: str, exp: str, symbols: str) -> str:
    return f"""SELECT o_orderkey, {raw} AS raw, CAST({exp} AS DOUBLE) AS amount, {symbols} AS symbols
FROM (SELECT {_SQL_ORD} FROM orders)"""


_ISO = "strftime(d, '%Y-%m-%d')"
_Y = "CAST(year(d) AS VARCHAR)"

# ---------------------------------------------------------------- dates


@register("date_canonical", _sql_date_family(
    f"CASE WHEN o_orderkey % 10 = 0 THEN {_Y} || '-02-30' ELSE {_ISO} END",
    f"CASE WHEN o_orderkey % 10 = 0 THEN {_Y} || '-02-30' ELSE {_ISO} END", "0"))
def q_date_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """canonical text passes through unvalidated and is not counted as fixed."""
    return _date_family(spark, sf_dir, lambda k, y, m, d, dt: F.when(
        k % 10 == 0, F.concat(_s(y), F.lit("-02-30"))).otherwise(
        F.concat_ws("-", _s(y), _p2(m), _p2(d))))


@register("date_iso_token", _sql_date_family(
    f"'  paid   on ' || {_Y} || '/' || CAST(month(d) AS VARCHAR) || '/' || CAST(day(d) AS VARCHAR) || ' 10:15  '",
    _ISO, "1"))
def q_date_iso_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whitespace collapse, ISO token anywhere, time dropped."""
    return _date_family(spark, sf_dir, lambda k, y, m, d, dt: F.concat(
        F.lit("  paid   on "), _s(y), F.lit("/"), _s(m), F.lit("/"), _s(d), F.lit(" 10:15  ")))


@register("date_dmy", _sql_date_family(
    f"{_sql_p2('day(d)')} || '.' || {_sql_p2('month(d)')} || '.' || {_Y}", _ISO, "1"))
def q_date_dmy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """numeric token, day first."""
    return _date_family(spark, sf_dir, lambda k, y, m, d, dt: F.concat_ws(".", _p2(d), _p2(m), _s(y)))


@register("date_mdy", _sql_date_family(
    f"{_sql_p2('month(d)')} || '/' || {_sql_p2('day(d)')} || '/' || {_Y}",
    f"CASE WHEN day(d) > 12 THEN {_ISO} ELSE strftime(make_date(year(d), day(d), month(d)), '%Y-%m-%d') END",
    "1"))
def q_date_mdy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month-first text is read day-first unless the second part is above 12."""
    return _date_family(spark, sf_dir, lambda k, y, m, d, dt: F.concat_ws("/", _p2(m), _p2(d), _s(y)))


@register("date_two_digit_year", _sql_date_family(
    f"{_sql_p2('day(d)')} || '/' || {_sql_p2('month(d)')} || '/' || {_sql_p2('year(d) % 100')}",
    "strftime(make_date(2000 + year(d) % 100, month(d), day(d)), '%Y-%m-%d')", "1"))
def q_date_two_digit_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: two-digit years are 20yy, no pivot (95 -> 2095)."""
    return _date_family(spark, sf_dir, lambda k, y, m, d, dt: F.concat_ws(
        "/", _p2(d), _p2(m), _p2(y % 100)))


@register("date_month_name", _sql_date_family(
    f"""CASE o_orderkey % 4
      WHEN 0 THEN upper(CAST(day(d) AS VARCHAR) || ' ' || {_sql_list(MON_SHORT)}[month(d)] || ' ' || {_Y})
      WHEN 1 THEN lower({_sql_list(MON_FULL)}[month(d)] || ' ' || {_sql_p2('day(d)')} || ', ' || {_Y})
      WHEN 2 THEN {_sql_list(WEEKDAYS)}[dayofweek(d) + 1] || ', ' || {_sql_p2('day(d)')} || ' '
                  || {_sql_list(MON_FULL)}[month(d)] || ' ' || {_Y}
      ELSE {_sql_list(MON_SHORT)}[month(d)] || ' ' || CAST(day(d) AS VARCHAR) || ' ' || {_Y} END""",
    _ISO, "1"))
def q_date_month_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month names, either order, any case, weekday prefix, optional comma."""
    def text(k, y, m, d, dt):
        short, full = F.element_at(_arr(MON_SHORT), m), F.element_at(_arr(MON_FULL), m)
        wd = F.element_at(_arr(WEEKDAYS), F.dayofweek(dt))
        return (F.when(k % 4 == 0, F.upper(F.concat_ws(" ", _s(d), short, _s(y))))
                .when(k % 4 == 1, F.lower(F.concat(full, F.lit(" "), _p2(d), F.lit(", "), _s(y))))
                .when(k % 4 == 2, F.concat(wd, F.lit(", "), _p2(d), F.lit(" "), full, F.lit(" "), _s(y)))
                .otherwise(F.concat_ws(" ", short, _s(d), _s(y))))
    return _date_family(spark, sf_dir, text)


@register("date_impossible", _sql_date_family(
    f"""CASE o_orderkey % 3 WHEN 0 THEN '31/' || {_sql_p2('month(d)')} || '/' || {_Y}
      WHEN 1 THEN '30 Feb ' || {_Y} ELSE {_Y} || '/' || {_sql_p2('month(d)')} || '/32' END""",
    f"""CASE WHEN o_orderkey % 3 = 0 AND month(d) IN (1, 3, 5, 7, 8, 10, 12)
      THEN strftime(make_date(year(d), month(d), 31), '%Y-%m-%d') END""",
    "CASE WHEN o_orderkey % 3 = 0 AND month(d) IN (1, 3, 5, 7, 8, 10, 12) THEN 1 ELSE 0 END"))
def q_date_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """impossible calendar days become NULL and are not counted."""
    return _date_family(spark, sf_dir, lambda k, y, m, d, dt: F.when(
        k % 3 == 0, F.concat(F.lit("31/"), _p2(m), F.lit("/"), _s(y))).when(
        k % 3 == 1, F.concat(F.lit("30 Feb "), _s(y))).otherwise(
        F.concat(_s(y), F.lit("/"), _p2(m), F.lit("/32"))))


# ---------------------------------------------------------------- amounts

_GROUPED = "format('{:,.2f}', p)"
_PLAIN = "printf('%.2f', p)"
_SYM = f"{_sql_list(_SYMS)}[o_orderkey % 15 + 1]"


def _grouped(p: Column) -> Column:
    return F.format_number(p, 2)


def _plain(p: Column) -> Column:
    return F.format_string("%.2f", p)


def _sym(k: Column) -> Column:
    return F.element_at(_arr(_SYMS), (k % 15 + 1).cast("int"))


@register("amount_symbols", _sql_amount_family(f"{_SYM} || {_GROUPED}", "p", "1"))
def q_amount_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the 15 symbols, thousands separators."""
    return _amount_family(spark, sf_dir, lambda k, p: F.concat(_sym(k), _grouped(p)))


@register("amount_accounting_negative", _sql_amount_family(
    f"CASE WHEN o_orderkey % 2 = 0 THEN '(' || {_SYM} || {_GROUPED} || ')' ELSE '( ' || {_PLAIN} || ' )' END",
    "-p", "CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END"))
def q_amount_accounting_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3: "(...)" is negative; the inner text is trimmed."""
    return _amount_family(spark, sf_dir, lambda k, p: F.when(
        k % 2 == 0, F.concat(F.lit("("), _sym(k), _grouped(p), F.lit(")"))).otherwise(
        F.concat(F.lit("( "), _plain(p), F.lit(" )"))))


@register("amount_minus", _sql_amount_family(
    f"CASE WHEN o_orderkey % 2 = 0 THEN '-' || {_SYM} || {_PLAIN} ELSE {_SYM} || '-' || {_PLAIN} END",
    "CASE WHEN o_orderkey % 2 = 0 THEN -p ELSE p END", "1"))
def q_amount_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leading minus counts only before the symbol ("$-5" is +5)."""
    return _amount_family(spark, sf_dir, lambda k, p: F.when(
        k % 2 == 0, F.concat(F.lit("-"), _sym(k), _plain(p))).otherwise(
        F.concat(_sym(k), F.lit("-"), _plain(p))))


@register("amount_suffix_code", _sql_amount_family(
    f"{_PLAIN} || ' ' || {_sql_list(CODES)}[o_orderkey % 3 + 1]", "p", "0"))
def q_amount_suffix_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing currency codes are ignored."""
    return _amount_family(spark, sf_dir, lambda k, p: F.concat(
        _plain(p), F.lit(" "), F.element_at(_arr(CODES), (k % 3 + 1).cast("int"))))


@register("amount_quirks", _sql_amount_family(
    """CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(floor(p) AS BIGINT) AS VARCHAR) || 'abc'
      WHEN 1 THEN '.' || lpad(CAST(CAST(round(p * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')
      WHEN 2 THEN printf('%.2f', p) || '%'
      ELSE CAST(CAST(floor(p) AS BIGINT) AS VARCHAR) || 'e5' END""",
    """CASE o_orderkey % 4 WHEN 1 THEN CAST(round(p * 100) AS BIGINT) % 100
      WHEN 2 THEN p ELSE floor(p) END""", "0"))
def q_amount_quirks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First number only (".5" -> 5, "12abc" -> 12, "1e5" -> 1, "15%" -> 15)."""
    def text(k, p):
        whole = F.floor(p).cast("long").cast("string")
        cents = F.lpad((F.round(p * 100).cast("long") % 100).cast("string"), 2, "0")
        return (F.when(k % 4 == 0, F.concat(whole, F.lit("abc")))
                .when(k % 4 == 1, F.concat(F.lit("."), cents))
                .when(k % 4 == 2, F.concat(_plain(p), F.lit("%")))
                .otherwise(F.concat(whole, F.lit("e5"))))
    return _amount_family(spark, sf_dir, text)


@register("currency_symbol_count", _sql_amount_family(
    f"repeat({_SYM}, CAST(o_orderkey % 4 AS INTEGER)) || {_PLAIN}", "p", "CAST(o_orderkey % 4 AS INTEGER)"))
def q_currency_symbol_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol occurrence is counted."""
    def text(k, p):
        s = _sym(k)
        reps = (F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, s)
                .when(k % 4 == 2, F.concat(s, s)).otherwise(F.concat(s, s, s)))
        return F.concat(reps, _plain(p))
    return _amount_family(spark, sf_dir, text)


# ---------------------------------------------------------------- text, roles, projection

# Memo texts by o_orderkey % 10 (the last slot takes the order text).
MEMO_TEXTS = ["NULL", " none ", "NaN", "na", "", "N/A", "-", "?", "  Spaced  text  "]
_DESC_SQL = ("o_orderstatus || ' order ' || lower(o_orderpriority) || ' cust ' || "
             "CAST(o_custkey AS VARCHAR)")


def _desc(o: DataFrame) -> Column:
    return F.concat_ws(" ", F.col("o_orderstatus"), F.lit("order"), F.lower(F.col("o_orderpriority")),
                       F.lit("cust"), F.col("o_custkey").cast("string"))


@register("null_like", f"""
SELECT o_orderkey, raw,
  CASE WHEN lower(trim(raw)) IN ('', 'nan', 'na', 'null', 'none') THEN NULL ELSE trim(raw) END AS memo
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN {_DESC_SQL}
        ELSE {_sql_list(MEMO_TEXTS)}[o_orderkey % 10 + 1] END AS raw FROM orders)""")
def q_null_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-like text -> NULL; "N/A", "-", "?" are text; trim keeps inner spaces."""
    from ..functions.text import clean_text
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    raw = F.when(k % 10 == 9, _desc(o)).otherwise(F.element_at(_arr(MEMO_TEXTS), (k % 10 + 1).cast("int")))
    return o.select(k, raw.alias("raw")).select("o_orderkey", "raw", clean_text(F.col("raw")).alias("memo"))


@register("roles_inferred", f"""
SELECT o_orderkey, {_ISO} AS txn_date, {_DESC_SQL} AS memo, p AS net_amount,
  {_ISO} AS trade_date, {_PLAIN} AS total_price, {_ISO} AS "Value Date", p AS "Debit"
FROM (SELECT *, {_SQL_ORD} FROM orders)""")
def q_roles_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles from header names; a `Value Date` column is a date;
    `trade_date` and `total_price` stay text because a primary name matched."""
    o = _orders(spark, sf_dir)
    d, p = F.col("o_orderdate").cast("date"), F.col("o_totalprice")
    y, m, dd = F.year(d), F.month(d), F.dayofmonth(d)
    raw = o.select(
        F.col("o_orderkey"),
        F.concat_ws("/", _p2(dd), _p2(m), _s(y)).alias("txn_date"),
        _desc(o).alias("memo"),
        F.concat(F.lit("₹"), _grouped(p)).alias("net_amount"),
        F.concat(F.lit("  "), F.concat_ws("-", _s(y), _p2(m), _p2(dd)), F.lit(" ")).alias("trade_date"),
        _plain(p).alias("total_price"),
        F.concat_ws(".", _s(y), _p2(m), _p2(dd)).alias("Value Date"),
        F.concat(F.lit("$"), _plain(p)).alias("Debit"),
    )
    res = clean(with_order(raw, "o_orderkey").drop("o_orderkey"))
    return res.audit.select(F.col(f"{ORD}.o_orderkey").alias("o_orderkey"),
                            *[named(c) for c in res.roles.output_columns])


@register("project_ignore", _MESSY + """,
k AS (SELECT *, coalesce(exp_date, '') AS k_date, coalesce(printf('%.2f', exp_amount), '') AS k_amount
      FROM m WHERE exp_date IS NOT NULL OR exp_amount IS NOT NULL)
SELECT copy, o_orderkey, exp_date AS date, CAST(NULL AS VARCHAR) AS description, exp_amount AS amount,
       CAST(NULL AS VARCHAR) AS missing
FROM k QUALIFY row_number() OVER (PARTITION BY k_date, k_amount ORDER BY copy, o_orderkey) = 1""")
def q_project_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ignored column is empty and out of the dedupe key; an unknown
    output column is NULL."""
    from .roles import ColumnMapping
    res = clean_messy(spark, sf_dir, mapping=ColumnMapping(
        date_columns=["date"], amount_columns=["amount"], ignore_columns=["description"],
        output_columns=["date", "description", "amount", "missing"]))
    return res.cleaned.select(*_ids(res.cleaned), "date", "description", "amount", "missing")


# ---------------------------------------------------------------- rows, dedupe, stats, audit

@register("drop_empty_rows", _MESSY + "\nSELECT copy, o_orderkey FROM m WHERE empty_row")
def q_drop_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows empty in every output column are dropped before dedupe."""
    res = clean_messy(spark, sf_dir)
    gone = res.all_rows.where(~F.col(LIVE))
    return gone.select(*_ids(gone))


@register("dedupe_first_wins", _KEYED + """
SELECT copy, o_orderkey, exp_date AS date, exp_desc AS description, exp_amount AS amount,
       count(*) OVER (PARTITION BY k_date, k_desc, k_amount) - 1 AS duplicates
FROM k
QUALIFY row_number() OVER (PARTITION BY k_date, k_desc, k_amount ORDER BY copy, o_orderkey) = 1""")
def q_dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row per normalised key, with the group's duplicate count."""
    from ..operators.dedupe import GROUP_SIZE
    from .clean_job import EMPTY
    res = clean_messy(spark, sf_dir)
    g = res.groups.where(~F.col(EMPTY))
    return g.select(*_ids(g), "date", "description", "amount",
                    (F.col(GROUP_SIZE) - 1).alias("duplicates"))


_STATS_SQL = _KEYED + """,
agg AS (
  SELECT (SELECT count(*) FROM m) AS total_rows_input,
         (SELECT count(*) FROM (SELECT DISTINCT k_date, k_desc, k_amount FROM k)) AS total_rows_cleaned,
         (SELECT count(*) FROM k) - (SELECT count(*) FROM (SELECT DISTINCT k_date, k_desc, k_amount FROM k))
           AS duplicates_removed,
         CAST(0 AS BIGINT) AS ghost_transactions_removed,
         CAST((SELECT sum(exp_symbols) FROM m) AS BIGINT) AS currency_symbols_found,
         CAST((SELECT sum(exp_fixed) FROM m) AS BIGINT) AS invalid_dates_fixed,
         (SELECT count(*) FROM m WHERE empty_row) AS all_empty)"""


@register("clean_stats", _STATS_SQL + """
SELECT total_rows_input, total_rows_cleaned, duplicates_removed, ghost_transactions_removed,
       currency_symbols_found, invalid_dates_fixed FROM agg""")
def q_clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the stats record."""
    st = clean_messy(spark, sf_dir).stats()
    return st.select("total_rows_input", "total_rows_cleaned", "duplicates_removed",
                     "ghost_transactions_removed", "currency_symbols_found", "invalid_dates_fixed")


@register("row_accounting", _STATS_SQL + """
SELECT total_rows_input, all_empty, duplicates_removed, ghost_transactions_removed, total_rows_cleaned,
       total_rows_input = all_empty + duplicates_removed + ghost_transactions_removed + total_rows_cleaned
         AS balanced FROM agg""")
def q_row_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """input = all-empty + duplicates + ghosts + cleaned."""
    return clean_messy(spark, sf_dir).accounting()


@register("row_audit", _MESSY + """
SELECT copy, o_orderkey, exp_date AS date, exp_desc AS description, exp_amount AS amount,
       exp_fixed AS date_fixed, exp_symbols AS currency_symbols_found
FROM m WHERE NOT empty_row""")
def q_row_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-empty row after cell cleaning, before dedupe, with its counters."""
    a = clean_messy(spark, sf_dir).audit
    return a.select(*_ids(a), "date", "description", "amount", "date_fixed", "currency_symbols_found")


@register("audit_line", _MESSY + """,
n AS (SELECT *, row_number() OVER (ORDER BY copy, o_orderkey) - 1 AS idx FROM m)
SELECT copy, o_orderkey,
  '[' || idx || '] ' || coalesce(exp_date, 'None') || ' | ' || coalesce(exp_desc, 'None') || ' | '
  || coalesce(CAST(exp_amount AS VARCHAR), 'None') || ' (date_fixed=' || exp_fixed
  || ', currency_found=' || exp_symbols || ')' AS line
FROM n WHERE NOT empty_row""")
def q_audit_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verbose per-row line, with the 0-based index among all input rows."""
    res = clean_messy(spark, sf_dir)
    lines = res.audit_lines()
    return lines.select(*_ids(lines), "line")


@register("preview", _DEDUPED + """
SELECT copy, o_orderkey, exp_date AS date, exp_desc AS description, exp_amount AS amount
FROM d ORDER BY copy, o_orderkey LIMIT 10""")
def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 (E2 without the limit): the first cleaned rows in arrival order; the limit is
    the feature."""
    p = clean_messy(spark, sf_dir).preview(10)
    return p.select(*_ids(p), "date", "description", "amount")


# ---------------------------------------------------------------- sinks read back

def _shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    import uuid
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/txnclean-{what}-{uuid.uuid4().hex[:12]}"


def _h4_sql(x: str) -> str:
    return f"regexp_replace(printf('%.2f', {x}), '\\.?0+$', '')"


@register("csv_roundtrip", _DEDUPED + f"""
SELECT exp_date AS date, exp_desc AS description, {_h4_sql('exp_amount')} AS amount FROM d""")
def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2, A4, H4: write the cleaned CSV (ordered parts), read it back."""
    from ..sources.csv_sink import write_csv
    from ..sources.csv_source import read_csv
    res = clean_messy(spark, sf_dir)
    path = _shared_dir(spark, "csv")
    write_csv(res.csv_frame(), path)
    back = read_csv(spark, path)
    return back.select("date", "description", "amount")


def _report_sql() -> str:
    nl = "' || chr(10) || '"
    body = (f"'{{{nl}  \"total_rows_input\": ' || total_rows_input || ',{nl}  \"total_rows_cleaned\": ' || "
            f"total_rows_cleaned || ',{nl}  \"duplicates_removed\": ' || duplicates_removed || ',{nl}"
            f"  \"ghost_transactions_removed\": ' || ghost_transactions_removed || ',{nl}"
            f"  \"currency_symbols_found\": ' || currency_symbols_found || ',{nl}"
            f"  \"invalid_dates_fixed\": ' || invalid_dates_fixed || ',{nl}"
            f"  \"date_columns\": [{nl}    \"date\"{nl}  ],{nl}"
            f"  \"amount_columns\": [{nl}    \"amount\"{nl}  ],{nl}"
            f"  \"output_columns\": [{nl}    \"date\",{nl}    \"description\",{nl}    \"amount\"{nl}  ],{nl}"
            f"  \"input_csv_path\": null,{nl}  \"output_csv_path\": null{nl}}}'")
    return _STATS_SQL + f"\nSELECT {body} AS report FROM agg"


@register("report_json", _report_sql())
def q_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the stats record as indented JSON (keys in record order), read back."""
    from ..sources.report import write_report
    path = _shared_dir(spark, "report") + "/report.json"
    write_report(spark, clean_messy(spark, sf_dir).stats(), path)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.regexp_replace("value", "\n$", "").alias("report"))


@register("report_csv", _STATS_SQL + """
SELECT CAST(total_rows_input AS VARCHAR) AS total_rows_input,
       CAST(total_rows_cleaned AS VARCHAR) AS total_rows_cleaned,
       CAST(duplicates_removed AS VARCHAR) AS duplicates_removed,
       CAST(ghost_transactions_removed AS VARCHAR) AS ghost_transactions_removed,
       CAST(currency_symbols_found AS VARCHAR) AS currency_symbols_found,
       CAST(invalid_dates_fixed AS VARCHAR) AS invalid_dates_fixed,
       '["date"]' AS date_columns, '["amount"]' AS amount_columns,
       '["date","description","amount"]' AS output_columns,
       CAST(NULL AS VARCHAR) AS input_csv_path, CAST(NULL AS VARCHAR) AS output_csv_path
FROM agg""")
def q_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header row + value row, lists as JSON text, read back."""
    from ..sources.report import write_report
    path = _shared_dir(spark, "report") + "/report.csv"
    write_report(spark, clean_messy(spark, sf_dir).stats(), path)
    return spark.read.options(header="true", quote='"', escape='"').csv(path)


@register("run_events", _STATS_SQL + """
SELECT 'clean_start' AS message, CAST(NULL AS BIGINT) AS total_rows_input,
       CAST(NULL AS BIGINT) AS total_rows_cleaned
UNION ALL SELECT 'clean_complete', total_rows_input, total_rows_cleaned FROM agg""")
def q_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events appended as JSON lines, read back."""
    from ..sources.events import log_event, read_events
    from ..sources.report import stats_dict
    logs = _shared_dir(spark, "events")
    log_event(spark, logs, "clean_start", input_csv_path=f"{sf_dir}/orders.parquet")
    stats = stats_dict(clean_messy(spark, sf_dir).stats())
    log_event(spark, logs, "clean_complete", **stats)
    ev = read_events(spark, logs)
    return ev.select("message", F.col("total_rows_input").cast("bigint"),
                     F.col("total_rows_cleaned").cast("bigint"))


# ---------------------------------------------------------------- ghosts

def _ghost_frame(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    """Orders plus near copies: within tolerance, with a NULL date or amount, a day
    later, or (text variant) a one-letter longer / an unrelated description."""
    o = _orders(spark, sf_dir)
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    d = F.col("o_orderdate").cast("date")
    iso = F.date_format(d, "yyyy-MM-dd")
    dmy = F.date_format(d, "dd/MM/yyyy")
    plain, near = F.format_string("%.2f", p), F.format_string("%.3f", p + F.lit(0.004))
    txt = F.concat(F.lit("payment to vendor "), F.col("o_custkey").cast("string"), F.lit(" ref "),
                   k.cast("string"))
    second = "description" if with_text else "note"

    def rows(copy: int, date: Column, note: Column, amount: Column, keep: Column | None = None):
        sel = o.select(F.lit(copy).alias("copy"), k, date.alias("date"), note.alias(second),
                       amount.alias("amount"))
        return sel if keep is None else sel.where(keep)

    if with_text:
        parts = [rows(0, iso, txt, plain),
                 rows(1, iso, F.concat(txt, F.lit("s")), near),
                 rows(2, dmy, F.concat(F.lit("refund "), k.cast("string")),
                      F.format_string("%.3f", p + F.lit(0.003)))]
    else:
        parts = [rows(0, iso, F.lit("n0"), plain),
                 rows(1, dmy, F.lit("n1"), near),
                 rows(2, iso, F.lit("n2"), F.lit(""), k % 3 == 0),
                 rows(3, F.lit(""), F.lit("n3"), plain, k % 3 == 1),
                 rows(4, F.date_format(F.date_add(d, 1), "yyyy-MM-dd"), F.lit("n4"), plain, k % 3 == 2)]
    return reduce(DataFrame.unionByName, parts)


def _ghost_sql(with_text: bool) -> str:
    """Greedy keep-first where every match chain has depth one: a row is kept iff no
    earlier *root* row (one without an earlier match) matches it. Matching is split
    into equi/range joins by which values are present."""
    iso = "strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')"
    if with_text:
        txt = "'payment to vendor ' || CAST(o_custkey AS VARCHAR) || ' ref ' || CAST(o_orderkey AS VARCHAR)"
        raw = f"""
  SELECT 0 AS copy, o_orderkey, {iso} AS date, {txt} AS t, round(o_totalprice, 2) AS am FROM orders
  UNION ALL SELECT 1, o_orderkey, {iso}, {txt} || 's', CAST(printf('%.3f', o_totalprice + 0.004) AS DOUBLE) FROM orders
  UNION ALL SELECT 2, o_orderkey, {iso}, 'refund ' || CAST(o_orderkey AS VARCHAR),
                   CAST(printf('%.3f', o_totalprice + 0.003) AS DOUBLE) FROM orders"""
    else:
        raw = f"""
  SELECT 0 AS copy, o_orderkey, {iso} AS date, 'n0' AS t, round(o_totalprice, 2) AS am FROM orders
  UNION ALL SELECT 1, o_orderkey, {iso}, 'n1', CAST(printf('%.3f', o_totalprice + 0.004) AS DOUBLE) FROM orders
  UNION ALL SELECT 2, o_orderkey, {iso}, 'n2', NULL FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 3, o_orderkey, NULL, 'n3', round(o_totalprice, 2) FROM orders WHERE o_orderkey % 3 = 1
  UNION ALL SELECT 4, o_orderkey, strftime(CAST(o_orderdate AS DATE) + 1, '%Y-%m-%d'), 'n4',
                   round(o_totalprice, 2) FROM orders WHERE o_orderkey % 3 = 2"""
    # text test: equal texts, or the later text is the earlier one plus 's' (ratio 2L/(2L+1))
    tm = ("(i.t = j.t OR (i.t = j.t || 's' AND 2.0 * length(j.t) >= 0.9 * (2 * length(j.t) + 1)))"
          if with_text else "TRUE")

    def exists(src: str) -> str:
        return f"""(
      EXISTS (SELECT 1 FROM {src} j WHERE j.dn = i.dn AND j.am BETWEEN i.am - 0.011 AND i.am + 0.011
              AND abs(i.am - j.am) <= 0.01 AND j.ord < i.ord AND {tm})
   OR EXISTS (SELECT 1 FROM {src} j WHERE j.dn = i.dn AND (i.am IS NULL OR j.am IS NULL)
              AND j.ord < i.ord AND {tm})
   OR EXISTS (SELECT 1 FROM {src} j WHERE (i.dn IS NULL OR j.dn IS NULL)
              AND j.am BETWEEN i.am - 0.011 AND i.am + 0.011 AND abs(i.am - j.am) <= 0.01
              AND j.ord < i.ord AND {tm})
   OR EXISTS (SELECT 1 FROM {src} j WHERE (i.dn IS NULL OR j.dn IS NULL) AND (i.am IS NULL OR j.am IS NULL)
              AND j.ord < i.ord AND {tm}))"""

    return f"""
WITH raw AS ({raw}),
r AS (
  SELECT copy, o_orderkey, date, t, am, CAST(date AS DATE) AS dn, copy * 10000000000 + o_orderkey AS ord
  FROM raw
  QUALIFY row_number() OVER (PARTITION BY coalesce(date, ''), lower(t), coalesce(printf('%.2f', am), '')
                             ORDER BY copy, o_orderkey) = 1),
roots AS (SELECT * FROM r i WHERE NOT {exists('r')})
SELECT copy, o_orderkey, date, t AS {'description' if with_text else 'note'}, am AS amount
FROM r i WHERE NOT {exists('roots')}"""


@register("amount_halves", """
SELECT o_orderkey, printf('%.2f', (o_orderkey * 10 + 5) / 1000.0) AS up, printf('%.2f', -(o_orderkey * 10 + 5) / 1000.0) AS down,
       printf('%.2f', o_totalprice) AS price FROM orders""")
def q_amount_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2, H4: amounts that end in a 5 at the third place are rounded by their exact binary value."""
    from ..functions.keys import two_places
    k = F.col("o_orderkey")
    half = (k * 10 + 5) / F.lit(1000.0)
    return _orders(spark, sf_dir).select(k, two_places(half).alias("up"), two_places(-half).alias("down"),
                                         two_places(F.col("o_totalprice").cast("double")).alias("price"))


@register("ghosts_amount_date", _ghost_sql(False))
def q_ghosts_amount_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount band, date band, NULL wildcards, greedy keep-first
    (no text column: the header is `note`)."""
    from .clean_job import GhostOptions
    df = with_order(_ghost_frame(spark, sf_dir, False), ["copy", "o_orderkey"]).drop("copy", "o_orderkey")
    res = clean(df, ghosts=GhostOptions(enabled=True))
    return res.cleaned.select(*_ids(res.cleaned), "date", "note", "amount")


@register("ghosts_text", _ghost_sql(True))
def q_ghosts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`description` text similarity (ratio >= 0.9) on top of the bands."""
    from .clean_job import GhostOptions
    df = with_order(_ghost_frame(spark, sf_dir, True), ["copy", "o_orderkey"]).drop("copy", "o_orderkey")
    res = clean(df, ghosts=GhostOptions(enabled=True, threshold=0.9))
    return res.cleaned.select(*_ids(res.cleaned), "date", "description", "amount")


@register("ghosts_chain", """
SELECT copy, o_orderkey, strftime(CAST(o_orderdate AS DATE) + shift, '%Y-%m-%d') AS date, 'n' || copy AS note,
       CAST(printf('%.2f', o_orderkey * 10 + cents / 100.0) AS DOUBLE) AS amount
FROM orders, (VALUES (0, 0, 0), (2, 2, 0), (4, 4, 0), (5, 500, 0), (6, 500, 2)) v(copy, cents, shift)""")
def q_ghosts_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2, C3, C6, C8 at tolerances of their own: chains in which each row matches the one before only
    (every second stays), and a pair two days apart at a tolerance of one (both stay)."""
    from .clean_job import GhostOptions
    o = _orders(spark, sf_dir)
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    # amount in cents above ten times the key, and days after the order's date
    shape = [(0, 0, 0), (1, 1, 1), (2, 2, 0), (3, 3, 1), (4, 4, 0), (5, 500, 0), (6, 500, 2)]
    rows = reduce(DataFrame.unionByName, [
        o.select(F.lit(copy).alias("copy"), k, F.date_format(F.date_add(d, shift), "yyyy-MM-dd").alias("date"),
                 F.lit(f"n{copy}").alias("note"), F.format_string("%.2f", k * 10 + F.lit(cents / 100)).alias("amount"))
        for copy, cents, shift in shape])
    df = with_order(rows, ["copy", "o_orderkey"]).drop("copy", "o_orderkey")
    res = clean(df, ghosts=GhostOptions(enabled=True, amount_tol=0.015, date_tol_days=1))
    return res.cleaned.select(*_ids(res.cleaned), "date", "note", "amount")


@register("ghosts_long_chain", """
SELECT o_orderkey, '2026-04-16' AS date, 'n' || o_orderkey AS note, CAST(printf('%.3f', 10 + o_orderkey / 100.0) AS DOUBLE) AS amount
FROM orders WHERE o_orderkey % 2 = 0""")
def q_ghosts_long_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain through all orders, each amount within the tolerance of the one before and the next
    alone; every second row stays. Settled by the sequential rule inside the component, not in as many rounds."""
    from .clean_job import GhostOptions
    k = F.col("o_orderkey")
    df = with_order(_orders(spark, sf_dir).select(
        k, F.lit("2026-04-16").alias("date"), F.concat(F.lit("n"), k.cast("string")).alias("note"),
        F.format_string("%.3f", F.lit(10) + k / F.lit(100.0)).alias("amount")), ["o_orderkey"]).drop("o_orderkey")
    res = clean(df, ghosts=GhostOptions(enabled=True, amount_tol=0.015))
    return res.cleaned.select(F.col(f"{ORD}.o_orderkey").alias("o_orderkey"), "date", "note", "amount")


@register("ghosts_hot_bucket", """
WITH m AS (SELECT o_orderkey, 100.0 * (o_orderkey % 5) + (o_orderkey % 997) / 100000.0 + 1 AS amount FROM orders)
SELECT min(o_orderkey) AS o_orderkey, '2026-04-16' AS date, 'n' || min(o_orderkey) AS note,
       CAST(printf('%.5f', arg_min(amount, o_orderkey)) AS DOUBLE) AS amount
FROM m GROUP BY floor(amount / 100)""")
def q_ghosts_hot_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders on one day in five bands narrower than the tolerance: each band keeps its first
    row. A pair for each two rows of a band would be a tenth of the square of the table."""
    from .clean_job import GhostOptions
    k = F.col("o_orderkey")
    amount = F.lit(100.0) * (k % 5) + (k % 997) / F.lit(100000.0) + 1
    df = with_order(_orders(spark, sf_dir).select(
        k, F.lit("2026-04-16").alias("date"), F.concat(F.lit("n"), k.cast("string")).alias("note"),
        F.format_string("%.5f", amount).alias("amount")), ["o_orderkey"]).drop("o_orderkey")
    res = clean(df, ghosts=GhostOptions(enabled=True))
    return res.cleaned.select(F.col(f"{ORD}.o_orderkey").alias("o_orderkey"), "date", "note", "amount")


@register("ghosts_text_only", """
WITH t AS (SELECT 0 AS copy, o_orderkey, CAST(o_orderkey AS VARCHAR) AS s FROM orders
  UNION ALL SELECT 2, o_orderkey, o_orderkey || 'x' FROM orders WHERE o_orderkey % 4 = 0)
SELECT copy, o_orderkey, 'payment ' || to_base64(unhex(md5(s) || md5(s || 'y'))) AS description FROM t""")
def q_ghosts_text_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 without a date or an amount: texts of one template, near copies of them (a letter more, or one
    letter replaced) and others of the same template that are like none."""
    from .clean_job import GhostOptions
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey")

    def filled(s: Column) -> Column:
        return F.concat(F.lit("payment "), F.base64(F.unhex(F.concat(F.md5(s), F.md5(F.concat(s, F.lit("y")))))))

    text = filled(k.cast("string"))
    parts = [o.select(F.lit(0).alias("copy"), k, text.alias("description")),
             o.select(F.lit(1).alias("copy"), k, F.when(k % 2 == 0, F.concat(text, F.lit("s")))
                      .otherwise(F.overlay(text, F.lit("-"), F.lit(20), F.lit(1))).alias("description")),
             o.where(k % 4 == 0).select(F.lit(2).alias("copy"), k, filled(F.concat(k.cast("string"), F.lit("x"))).alias("description"))]
    df = with_order(reduce(DataFrame.unionByName, parts), ["copy", "o_orderkey"]).drop("copy", "o_orderkey")
    res = clean(df, ghosts=GhostOptions(enabled=True, threshold=0.9))
    return res.cleaned.select(*_ids(res.cleaned), "description")


# ---------------------------------------------------------------- load

@register("sql_types", """
SELECT * FROM (VALUES ('txn_date', 'DATE'), ('memo_date', 'VARCHAR'), ('total', 'FLOAT'),
  ('net_amount', 'VARCHAR'), ('debit', 'VARCHAR'), ('balance', 'FLOAT'), ('notes', 'VARCHAR'),
  ('price_or_blank', 'FLOAT'), ('blank_total', 'VARCHAR')) AS t(column_name, sql_type)
WHERE (SELECT count(*) FROM orders) > 0""")
def q_sql_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL types from the prefix sample of a text table derived from
    orders (a never-filled column makes the sample read the whole table)."""
    from ..operators.sample import infer_sql_types
    o = _orders(spark, sf_dir)
    k, p, d = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderdate").cast("date")
    df = o.select(
        F.struct(k).alias(ORD),
        F.date_format(d, "yyyy-MM-dd").alias("txn_date"),
        F.date_format(d, "dd/MM/yyyy").alias("memo_date"),
        _plain(p).alias("total"),
        F.concat(_plain(p), F.lit(" USD")).alias("net_amount"),
        _plain(p).alias("debit"),
        F.regexp_replace(_grouped(p), ",", "_").alias("balance"),
        _desc(o).alias("notes"),
        F.when(k % 2 == 0, F.lit("")).otherwise(_plain(p)).alias("price_or_blank"),
        F.lit("").alias("blank_total"),
    )
    cols = [c for c in df.columns if c != ORD]
    types = infer_sql_types(df, cols)
    return spark.createDataFrame([(c, types[c]) for c in cols], "column_name string, sql_type string")


def _load_twice(spark: SparkSession, sf_dir: str, truncate_second: bool) -> tuple[DataFrame, dict]:
    import uuid
    from .load_job import load
    res = clean_messy(spark, sf_dir)
    name = f"txnclean_load_{uuid.uuid4().hex[:10]}"
    path = _shared_dir(spark, "table")
    from pyspark import StorageLevel
    frame = res.csv_frame().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        load(frame, None, table_name=name, table_path=path)
        stats = load(frame, None, table_name=name, truncate=truncate_second, table_path=path)
    finally:
        frame.unpersist()
    return spark.table(name), stats


_LOADED_ROW = ("SELECT CAST(exp_date AS DATE) AS date, exp_desc AS description, CAST("
               + _h4_sql("exp_amount") + " AS DOUBLE) AS amount FROM d")
_LOADED = _DEDUPED + "\n" + _LOADED_ROW


@register("load_append", _DEDUPED + "\n" + _LOADED_ROW + "\nUNION ALL\n" + _LOADED_ROW)
def q_load_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed load into a table, twice in append mode."""
    t, _ = _load_twice(spark, sf_dir, truncate_second=False)
    return t.select("date", "description", "amount")


@register("load_truncate", _LOADED)
def q_load_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncate-then-load keeps the table and leaves one copy of the rows."""
    t, _ = _load_twice(spark, sf_dir, truncate_second=True)
    return t.select("date", "description", "amount")


@register("load_stats", _STATS_SQL + """
SELECT total_rows_cleaned AS rows_in_csv, total_rows_cleaned AS rows_inserted, true AS truncate,
       false AS postgres, 'DATE' AS date_type, 'VARCHAR' AS description_type, 'FLOAT' AS amount_type
FROM agg""")
def q_load_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load summary record."""
    _, st = _load_twice(spark, sf_dir, truncate_second=True)
    ct = st["column_types"]
    return spark.createDataFrame(
        [(st["rows_in_csv"], st["rows_inserted"], st["truncate"], st["postgres"],
          ct["date"], ct["description"], ct["amount"])],
        "rows_in_csv bigint, rows_inserted bigint, truncate boolean, postgres boolean, "
        "date_type string, description_type string, amount_type string")


# ---------------------------------------------------------------- hot key

@register("dedupe_hot_key", f"""
WITH r AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 3 = 0 THEN '2026-01-01' ELSE {_ISO} END AS date,
    CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE {_DESC_SQL} END AS description,
    CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE p END AS amount
  FROM (SELECT *, {_SQL_ORD} FROM orders))
SELECT o_orderkey, date, description, amount,
       count(*) OVER (PARTITION BY date, lower(description), printf('%.2f', amount)) - 1 AS duplicates
FROM r
QUALIFY row_number() OVER (PARTITION BY date, lower(description), printf('%.2f', amount)
                           ORDER BY o_orderkey) = 1""")
def q_dedupe_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 with one key holding a third of all rows: the partial aggregate folds the hot
    group map-side, and the first row in arrival order still wins."""
    from ..operators.dedupe import GROUP_SIZE
    from .clean_job import EMPTY
    o = _orders(spark, sf_dir)
    k, p, d = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderdate").cast("date")
    hot = k % 3 == 0
    raw = o.select(
        k,
        F.when(hot, F.lit("2026-01-01")).otherwise(F.date_format(d, "yyyy-MM-dd")).alias("date"),
        F.when(hot, F.lit("hot")).otherwise(_desc(o)).alias("description"),
        F.when(hot, F.lit("₹1.00")).otherwise(_plain(p)).alias("amount"))
    res = clean(with_order(raw, "o_orderkey").drop("o_orderkey"))
    g = res.groups.where(~F.col(EMPTY))
    return g.select(F.col(f"{ORD}.o_orderkey").alias("o_orderkey"), "date", "description", "amount",
                    (F.col(GROUP_SIZE) - 1).alias("duplicates"))


# ---------------------------------------------------------------- typed input, odd headers, listings

_TYPED_AMOUNT = ("CASE o_orderkey % 5 WHEN 0 THEN o_totalprice * CAST(100000 AS DOUBLE) WHEN 1 THEN o_totalprice "
                 "WHEN 2 THEN o_totalprice / CAST(1000000000 AS DOUBLE) WHEN 3 THEN -o_totalprice END")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame with double amounts of 1e7 and above, below 1e-3, negative and missing (NaN)."""
    o = _orders(spark, sf_dir).where("o_totalprice is not null")
    amount = F.when(F.col("o_orderkey") % 10 == 4, F.lit(float("nan"))).otherwise(F.expr(_TYPED_AMOUNT))
    df = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
                  F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("description"), amount.alias("amount"))
    return with_order(df, "o_orderkey").drop("o_orderkey")


_TYPED = ("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, 'order ' || o_orderkey AS description, "
          f"{_TYPED_AMOUNT} AS amount FROM orders WHERE o_totalprice IS NOT NULL")


def _key() -> Column:
    return F.col(f"{ORD}.o_orderkey").alias("o_orderkey")


@register("clean_typed_input", _TYPED)
def q_clean_typed_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 on numbers, cleaned twice: amounts are never read through text."""
    again = clean(clean(_typed(spark, sf_dir)).cleaned).cleaned
    return again.select(_key(), "date", "description", "amount")


@register("audit_line_amounts", f"""
WITH t AS ({_TYPED}), i AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM t)
SELECT o_orderkey, '[' || i || '] ' || date || ' | ' || description || ' | ' || coalesce(CAST(amount AS VARCHAR), 'None')
       || ' (date_fixed=0, currency_found=0)' AS line FROM i""")
def q_audit_line_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I2 with amounts of 1e7 and above and below 1e-4."""
    lines = clean(_typed(spark, sf_dir)).audit_lines()
    return lines.select(_key(), "line")


@register("clean_dotted_headers", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, 'ref ' || o_orderkey AS ref, o_totalprice AS amount,
       true AS date_found FROM orders WHERE o_totalprice IS NOT NULL""")
def q_clean_dotted_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with dots, blanks and backticks."""
    o = _orders(spark, sf_dir).where("o_totalprice is not null")
    df = o.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("Inv. Date"),
                  F.concat(F.lit("  ref "), F.col("o_orderkey").cast("string")).alias("Ref`No."), F.col("o_totalprice").alias("net.amount"))
    res = clean(with_order(df, "o_orderkey").drop("o_orderkey"))
    found = "Inv. Date" in res.roles.date_columns
    return res.cleaned.select(_key(), named("Inv. Date").alias("date"), named("Ref`No.").alias("ref"),
                              named("net.amount").cast("double").alias("amount"), F.lit(found).alias("date_found"))


@register("roles_fallback", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS trade_date, 'm ' || o_orderkey AS memo, o_totalprice AS total_price,
       'trade_date' AS date_columns, 'total_price' AS amount_columns FROM orders WHERE o_totalprice IS NOT NULL""")
def q_roles_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that only the fallback patterns find."""
    o = _orders(spark, sf_dir).where("o_totalprice is not null")
    df = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("trade_date"), F.concat(F.lit("m "), F.col("o_orderkey").cast("string")).alias("memo"),
                  F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("total_price"))
    res = clean(with_order(df, "o_orderkey").drop("o_orderkey"))
    return res.cleaned.select(_key(), "trade_date", "memo", "total_price", F.lit(",".join(res.roles.date_columns)).alias("date_columns"),
                              F.lit(",".join(res.roles.amount_columns)).alias("amount_columns"))


@register("full_listing", _DEDUPED + """
SELECT copy, o_orderkey, row_number() OVER (ORDER BY copy, o_orderkey) - 1 AS position, exp_date AS date, exp_desc AS description,
       exp_amount AS amount FROM d""")
def q_full_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaned rows in arrival order, with their positions."""
    from ..operators.ordering import with_dense_index
    p = with_dense_index(clean_messy(spark, sf_dir).ordered(), ORD, "position")
    return p.select(*_ids(p), "position", "date", "description", "amount")


@register("load_rescan", _LOADED)
def q_load_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned CSV is written, scanned again and loaded."""
    import uuid
    from ..sources.csv_sink import write_csv
    from .load_job import load_csv
    path, name = _shared_dir(spark, "csv"), f"txnclean_load_{uuid.uuid4().hex[:10]}"
    write_csv(clean_messy(spark, sf_dir).csv_frame(), path)
    stats = load_csv(spark, path, None, table_name=name, table_path=_shared_dir(spark, "table"))
    assert stats["rows_inserted"] == stats["rows_in_csv"]
    return spark.table(name).select("date", "description", "amount")


@register("text_summary", _STATS_SQL + """
SELECT chr(10) || 'Clean Summary' || chr(10) || 'Input rows: ' || total_rows_input || chr(10) || 'Cleaned rows: ' || total_rows_cleaned || chr(10)
       || 'Duplicates removed: ' || duplicates_removed || chr(10) || 'Ghost transactions removed: 0' || chr(10) || 'Currency symbols found: '
       || currency_symbols_found || chr(10) || 'Invalid dates fixed: ' || invalid_dates_fixed || chr(10) || 'Date columns: date' || chr(10)
       || 'Amount columns: amount' || chr(10) || 'Output CSV: None' AS summary FROM agg""")
def q_text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stats record as text."""
    from ..sources.report import stats_dict
    from .clean_job import clean_summary
    text = clean_summary(stats_dict(clean_messy(spark, sf_dir).stats()))
    return spark.createDataFrame([(text,)], "summary string")
