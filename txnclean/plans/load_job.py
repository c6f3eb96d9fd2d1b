"""The load job (J2): infer SQL types, convert values, write a table, report stats.

Passes over the input: (1) one aggregate - row count, each column's first non-blank
arrival position, and counts of values that cannot be converted; (2) the prefix
sample for type inference (E3/D8); (3) the table write. Bad values are found in
pass 1, so a load never starts when a FLOAT/DATE column holds a value that cannot be
converted (pinned P7: the reference raised mid-load after committing batches).
"""

from __future__ import annotations

from typing import Optional

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import float_from_text
from ..functions.names import named
from ..functions.text import is_null_like, trim_unicode
from ..operators.sample import profile, infer_sql_types
from ..sources.events import log_event, redact
from ..sources.jdbc_sink import resolve_target, write_table

ORD = "_ord"
# Spark column type per inferred SQL type.
SPARK_TYPES = {"DATE": "date", "FLOAT": "double", "VARCHAR": "string"}


def convert(c: Column, sql_type: str) -> Column:
    """Blank or null-like -> NULL; FLOAT -> double; DATE -> date; else text."""
    blank = c.isNull() | (trim_unicode(c) == "") | is_null_like(c)
    if sql_type == "FLOAT":
        value = float_from_text(c)
    elif sql_type == "DATE":
        value = trim_unicode(c).try_cast("date")
    else:
        value = c.cast("string")
    return F.when(blank, F.lit(None).cast(SPARK_TYPES[sql_type])).otherwise(value)


def load(df: DataFrame, db_url_or_path: Optional[str] = None, *,
         table_name: str = "financial_records", truncate: bool = False,
         batch_size: int = 1000, postgres_schema: str = "public",
         jdbc_properties: Optional[dict] = None, num_partitions: Optional[int] = None,
         log_dir: Optional[str] = None, source_path: Optional[str] = None,
         table_path: Optional[str] = None, load_id: Optional[str] = None) -> dict:
    """J2 on a DataFrame of text columns with ``_ord`` (e.g. :func:`read_csv` output or
    ``CleanResult.csv_frame()``). ``db_url_or_path=None`` writes a catalog table
    (``table_path`` places its files, e.g. in a shared folder). A JDBC load is all or nothing; with a
    ``load_id`` it is done once, however often it is run."""
    spark = df.sparkSession
    columns = [c for c in df.columns if c != ORD]
    if not columns:
        raise ValueError("CSV header not found (empty cleaned CSV).")
    target = resolve_target(db_url_or_path, table_name, postgres_schema, jdbc_properties)
    log_event(spark, log_dir, "sql_export_start", cleaned_csv_path=source_path,
              db_url_or_path=db_url_or_path, table_name=table_name)
    # The three passes read the same rows: keep them (memory, spilling to disk) so an
    # upstream clean job runs once; lost blocks are recomputed from lineage.
    # A frame that the caller has cached stays the caller's.
    own = df.storageLevel == StorageLevel.NONE
    if own:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    inserted = Observation()
    try:
        prof = profile(df, columns)
        types = infer_sql_types(df, columns, prof)
        for i, c in enumerate(columns):
            if types[c] == "FLOAT" and prof["bad_float"][i]:
                raise ValueError(f"column {c!r}: {prof['bad_float'][i]} value(s) are not numbers")
            if types[c] == "DATE" and prof["bad_date"][i]:
                raise ValueError(f"column {c!r}: {prof['bad_date'][i]} value(s) are not dates")
        out = df.select(*[convert(named(c), types[c]).alias(c) for c in columns]).observe(
            inserted, F.count(F.lit(1)).alias("rows"))
        rows_inserted = write_table(out, target, truncate=truncate, batch_size=batch_size, num_partitions=num_partitions,
                                    table_path=table_path, column_types=types, load_id=load_id)
        if rows_inserted is None:
            rows_inserted = inserted.get["rows"]
    finally:
        if own:
            df.unpersist()
    stats = {
        "cleaned_csv_path": source_path,
        "db_url_or_path": redact(db_url_or_path),
        "table_name": table_name,
        "rows_in_csv": prof["rows"],
        "rows_inserted": rows_inserted,
        "truncate": truncate,
        "postgres": target.postgres,
        "column_types": types,
    }
    log_event(spark, log_dir, "sql_export_complete", **stats)
    return stats


def load_csv(spark: SparkSession, cleaned_csv_path: str, db_url_or_path: Optional[str] = None,
             **kw) -> dict:
    """J2, path form: rescan the cleaned CSV (A7) and load it."""
    from ..sources.csv_source import read_csv
    df = read_csv(spark, cleaned_csv_path)
    return load(df, db_url_or_path, source_path=cleaned_csv_path, **kw)


def load_stats_frame(spark: SparkSession, stats: dict) -> DataFrame:
    """D11 as a one-row DataFrame."""
    return spark.createDataFrame(
        [stats],
        "cleaned_csv_path string, db_url_or_path string, table_name string, rows_in_csv bigint, "
        "rows_inserted bigint, truncate boolean, postgres boolean, column_types map<string,string>")


def load_summary(stats: dict) -> str:
    """The load's stats record as text."""
    from .clean_job import summary
    shown = {**stats, "truncate": True if stats.get("truncate") else [],
             "database": "PostgreSQL" if stats.get("postgres") else "SQLite"}
    types = [f"  - {c}: {t}" for c, t in (stats.get("column_types") or {}).items()]
    body = summary("Export Summary", [("Rows in CSV", "rows_in_csv"), ("Rows inserted", "rows_inserted"), ("Table", "table_name"),
                                      ("Truncate", "truncate"), ("Database", "database")], shown)
    return "\n".join([body.replace("Truncate: True", "Truncate: true"), *(["Inferred column types:", *types] if types else [])])
