"""The clean job (J1): DataFrame in, DataFrames out.

Plan: scan -> one narrow pass of cell rules (fused into the scan's codegen stages)
-> one ``groupBy`` on the normalised key with a partial aggregate before the shuffle
(D1) -> optional ghost removal (C1-C6) -> sink. Every count of the stats record comes
from that one grouped table, so stats need no second pass over the input.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Optional

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import amount_text
from ..functions.names import named
from ..functions.numbers import number_text
from ..operators.cells import DATE_FIXED, LIVE, SYMBOLS, clean_cells, key_columns
from ..operators.dedupe import GROUP_SIZE, first_per_key
from .roles import ColumnMapping, ResolvedRoles, ghost_columns, resolve_roles

ORD = "_ord"
EMPTY = "__tc_empty"
GHOST = "__tc_ghost"
SYM_SUM = "__tc_sym"
FIXED_SUM = "__tc_fixed"
GROUP_LIVE = "__tc_group_live"


@dataclass(frozen=True)
class GhostOptions:
    """Near-duplicate removal switch and parameters (reference defaults)."""

    enabled: bool = False
    threshold: float = 0.9
    amount_tol: float = 0.01
    date_tol_days: int = 0
    max_rounds: Optional[int] = None   # fail loudly instead of looping longer


@dataclass
class CleanResult:
    roles: ResolvedRoles
    groups: DataFrame       # one row per dedupe key (incl. the all-empty group), flagged
    cleaned: DataFrame      # _ord + output columns, first-wins, ghosts removed
    audit: DataFrame        # I1: non-empty rows before dedupe + per-row counters
    input_path: Optional[str] = None
    output_path: Optional[str] = None
    cached: Optional[DataFrame] = None
    all_rows: Optional[DataFrame] = None   # every input row after cell cleaning
    ghost_metrics: dict = field(default_factory=dict)   # filled when ghost removal runs

    def release(self) -> None:
        """Drop the cached grouped table (see ``clean(persist=True)``)."""
        if self.cached is not None:
            self.cached.unpersist()

    def stats(self) -> DataFrame:
        """The one-row stats record, fields in the reference's order."""
        return stats_frame(self.groups, self.roles, self.input_path, self.output_path)

    def ordered(self) -> DataFrame:
        """Cleaned rows in first-appearance order."""
        return self.cleaned.orderBy(ORD)

    def preview(self, n: int = 10) -> DataFrame:
        """The first ``n`` cleaned rows (0 or negative -> none)."""
        return self.cleaned.orderBy(ORD).limit(max(int(n), 0))

    def csv_frame(self) -> DataFrame:
        """A4/H4: cleaned rows as the text the CSV sink writes (amounts in short form)."""
        return to_text_frame(self.cleaned, self.roles)

    def audit_lines(self) -> DataFrame:
        """One verbose line per non-empty row, indexed among all input rows."""
        return audit_lines(self.all_rows)

    def accounting(self) -> DataFrame:
        """input = all-empty + duplicates + ghosts + cleaned, as one aggregate."""
        n, live = F.col(GROUP_SIZE), ~F.col(EMPTY)

        def total(c: Column) -> Column:
            return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        acc = self.groups.agg(
            total(n).alias("total_rows_input"),
            total(F.when(~live, n)).alias("all_empty"),
            total(F.when(live, n - 1)).alias("duplicates_removed"),
            total(F.when(live & F.col(GHOST), 1)).alias("ghost_transactions_removed"),
            total(F.when(live & ~F.col(GHOST), 1)).alias("total_rows_cleaned"))
        return acc.withColumn("balanced", F.col("total_rows_input") == F.col("all_empty")
                              + F.col("duplicates_removed") + F.col("ghost_transactions_removed")
                              + F.col("total_rows_cleaned"))


def with_order(df: DataFrame, order_by: list[str] | str | None) -> DataFrame:
    """A3 for a caller's DataFrame: ``_ord`` from explicit order columns."""
    if ORD in df.columns and order_by is None:
        return df
    if order_by is None:
        raise ValueError("a DataFrame without _ord needs order_by= (first row wins by it)")
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.withColumn(ORD, F.struct(*[named(c) for c in cols]))


def clean(df: DataFrame, mapping: Optional[ColumnMapping] = None, *,
          order_by: list[str] | str | None = None,
          ghosts: GhostOptions = GhostOptions(),
          input_path: Optional[str] = None, output_path: Optional[str] = None,
          persist: bool = False, repartition: Optional[int] = None) -> CleanResult:
    """Clean a DataFrame of raw cells.

    ``df`` holds raw cells (any type; numbers in amount columns stay numbers) and either an ``_ord`` column
    (as :func:`txnclean.sources.csv_source.read_csv` adds) or ``order_by`` columns.
    ``persist=True`` keeps the grouped table (after the one shuffle) in memory/disk so
    the output write and the stats read it once; lost blocks are recomputed from
    lineage, so executor loss only costs time (with ghost removal they read its checkpoint, and nothing is cached). ``repartition=n`` deals the input out to n
    partitions first (for one small file or a single multi-line split); the order column is
    fixed before, so this does not change which row wins.
    """
    df = with_order(df, order_by)
    if repartition:
        df = df.repartition(repartition)
    header = [c for c in df.columns if c != ORD]
    roles = resolve_roles(header, mapping)
    cells = clean_cells(df, roles, ORD)

    keys = key_columns(roles)
    value_cols = [named(c) for c in (ORD, *roles.output_columns)]
    grouped = first_per_key(
        cells.select(*value_cols, DATE_FIXED, SYMBOLS, LIVE),
        keys, ORD,
        extra_aggs=[F.sum(DATE_FIXED).alias(FIXED_SUM), F.sum(SYMBOLS).alias(SYM_SUM),
                    F.max(LIVE).alias(GROUP_LIVE)],
    )
    # The all-empty rows (B6) form exactly one group: the key whose parts are all ''.
    # Its flag comes out of the aggregate, so filters on it stay above the shuffle.
    grouped = grouped.select(*value_cols, GROUP_SIZE, FIXED_SUM, SYM_SUM,
                             (~F.col(GROUP_LIVE)).alias(EMPTY))
    # read more than once (output + stats); ghost removal keeps a checkpoint of it instead
    persist = persist and not ghosts.enabled
    if persist:
        grouped = grouped.persist(StorageLevel.MEMORY_AND_DISK)

    ghost_metrics: dict = {}
    if ghosts.enabled:
        from ..operators.ghosts import flag_ghosts
        groups = flag_ghosts(grouped, roles, ghost_columns(roles), ghosts, ORD, metrics=ghost_metrics, apart=EMPTY)
    else:
        groups = grouped.withColumn(GHOST, F.lit(False))   # one scan, no union
    cleaned = groups.filter(~F.col(EMPTY) & ~F.col(GHOST)).select(*value_cols)

    audit = cells.filter(F.col(LIVE)).select(
        *value_cols, F.col(DATE_FIXED).alias("date_fixed"),
        F.col(SYMBOLS).alias("currency_symbols_found"))
    all_rows = cells.select(*value_cols, F.col(DATE_FIXED).alias("date_fixed"),
                            F.col(SYMBOLS).alias("currency_symbols_found"), LIVE)
    return CleanResult(roles, groups, cleaned, audit, input_path, output_path,
                       grouped if persist else None, all_rows, ghost_metrics)


def stats_frame(groups: DataFrame, roles: ResolvedRoles, input_path: Optional[str],
                output_path: Optional[str]) -> DataFrame:
    """D2-D7, D10 from the grouped table in one aggregate."""
    n = F.col(GROUP_SIZE)
    live = ~F.col(EMPTY)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    def names(xs: list[str]) -> Column:
        return F.array(*[F.lit(x) for x in xs]).cast("array<string>")

    return groups.agg(
        total(n).alias("total_rows_input"),
        total(F.when(live & ~F.col(GHOST), 1)).alias("total_rows_cleaned"),
        total(F.when(live, n - 1)).alias("duplicates_removed"),
        total(F.when(live & F.col(GHOST), 1)).alias("ghost_transactions_removed"),
        total(F.col(SYM_SUM)).alias("currency_symbols_found"),
        total(F.col(FIXED_SUM)).alias("invalid_dates_fixed"),
    ).select(
        "*",
        names(roles.date_columns).alias("date_columns"),
        names(roles.amount_columns).alias("amount_columns"),
        names(roles.output_columns).alias("output_columns"),
        F.lit(input_path).cast("string").alias("input_csv_path"),
        F.lit(output_path).cast("string").alias("output_csv_path"),
    )


def to_text_frame(cleaned: DataFrame, roles: ResolvedRoles) -> DataFrame:
    """Output columns as text: amounts in H4 short form; ``_ord`` kept for ordering."""
    cols = []
    for c in roles.output_columns:
        col = named(c)
        cols.append((amount_text(col) if roles.role(c) == "amount" else col.cast("string")).alias(c))
    return cleaned.select(ORD, *cols)


def _py_str(c: Column) -> Column:
    """Python ``str()`` of a cleaned value for the verbose line (None -> 'None')."""
    return F.coalesce(c, F.lit("None"))


def audit_lines(all_rows: DataFrame) -> DataFrame:
    """``[i] date | description | amount (date_fixed=.., currency_found=..)``.

    ``i`` is the 0-based position among *all* input rows (empty ones included), from
    a distributed dense index. Columns named ``date``/``description``/``amount`` are
    read when present.
    """
    from ..operators.ordering import with_dense_index

    def part(name: str) -> Column:
        return _py_str(number_text(named(name), all_rows.schema[name].dataType)) if name in all_rows.columns else F.lit("")

    indexed = with_dense_index(all_rows, ORD, "__tc_idx")
    return indexed.where(F.col(LIVE)).select(
        ORD,
        F.format_string("[%d] %s | %s | %s (date_fixed=%d, currency_found=%d)",
                        F.col("__tc_idx"), part("date"), part("description"), part("amount"),
                        F.col("date_fixed"), F.col("currency_symbols_found")).alias("line"))


def clean_csv(spark: SparkSession, input_csv_path: str, output_csv_path: str,
              mapping: Optional[ColumnMapping] = None, *,
              ghosts: GhostOptions = GhostOptions(),
              report_path: Optional[str] = None, log_dir: Optional[str] = None,
              multi_line: bool = True, single_file: bool = False,
              line_sep: str = "\r\n", repartition: Optional[int] = None) -> dict:
    """J1, path form: read CSV, clean, write the cleaned CSV (+ report), return stats.

    Raises FileNotFoundError for a missing input and ValueError for a file without
    a header. ``output_csv_path`` and ``report_path`` are folders (pinned P11).
    """
    from ..sources.csv_sink import write_csv
    from ..sources.csv_source import read_csv
    from ..sources.events import log_event
    from ..sources.report import stats_dict, write_report

    log_event(spark, log_dir, "clean_start", input_csv_path=input_csv_path,
              output_csv_path=output_csv_path)
    res: Optional[CleanResult] = None
    try:
        df = read_csv(spark, input_csv_path, multi_line)
        res = clean(df, mapping, ghosts=ghosts, input_path=input_csv_path,
                    output_path=output_csv_path, persist=True, repartition=repartition)
        write_csv(res.csv_frame(), output_csv_path, line_sep=line_sep, single_file=single_file)
        stats_df = res.stats()
        stats = stats_dict(stats_df)
        log_event(spark, log_dir, "clean_complete", **stats)
        if report_path:
            write_report(spark, stats_df, report_path)
    except Exception as e:
        log_event(spark, log_dir, "clean_csv_error", level="ERROR", error=str(e))
        raise
    finally:
        if res is not None:
            res.release()
    return stats


SUMMARY = [("Input rows", "total_rows_input"), ("Cleaned rows", "total_rows_cleaned"),
           ("Duplicates removed", "duplicates_removed"), ("Ghost transactions removed", "ghost_transactions_removed"),
           ("Currency symbols found", "currency_symbols_found"), ("Invalid dates fixed", "invalid_dates_fixed"),
           ("Date columns", "date_columns"), ("Amount columns", "amount_columns"), ("Output CSV", "output_csv_path")]


def summary(title: str, fields: list[tuple[str, str]], stats: dict) -> str:
    """A stats record as text, a line per (label, field); empty lists are left out."""
    def shown(value) -> str:
        return ", ".join(value) if isinstance(value, list) else str(value)

    return "\n".join(["", title] + [f"{label}: {shown(stats.get(f))}" for label, f in fields if stats.get(f) != []])


def clean_summary(stats: dict) -> str:
    return summary("Clean Summary", SUMMARY, stats)
