"""Cell rules on a streaming DataFrame (re-aimed; the reference has no streams).

The cell rules (B1-B6, F, G) are stateless column expressions, so the same
projection runs on ``spark.readStream`` input unchanged. First-row-wins dedupe and
ghost removal need the whole ordered table and stay batch operators; a stream is
cleaned cell by cell and written out (e.g. to a table that the batch job then dedupes).
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import named
from ..operators.cells import DATE_FIXED, LIVE, SYMBOLS, clean_cells
from ..plans.roles import ColumnMapping, resolve_roles

ORD = "_ord"


def clean_stream(df: DataFrame, mapping: Optional[ColumnMapping] = None,
                 order_by: Optional[list[str]] = None) -> DataFrame:
    """Cleaned cells of a (streaming or batch) DataFrame, all-empty rows dropped.

    ``order_by`` columns (e.g. a source offset or file position) are carried as
    ``_ord`` so a later batch dedupe can apply first-row-wins.
    """
    cols = [c for c in df.columns if c not in (order_by or [])]
    ordered = df.withColumn(ORD, F.struct(*[named(c) for c in order_by])) if order_by \
        else df.withColumn(ORD, F.lit(None).cast("struct<pos:bigint>"))
    roles = resolve_roles(cols, mapping)
    cells = clean_cells(ordered, roles, ORD)
    return cells.where(F.col(LIVE)).select(
        ORD, *[named(c) for c in roles.output_columns],
        F.col(DATE_FIXED).alias("date_fixed"), F.col(SYMBOLS).alias("currency_symbols_found"))
