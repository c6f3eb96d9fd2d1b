"""Report sinks (A5, A6): the one-row stats record as JSON or CSV.

The stats record is one row of counts and column names, so it is rendered on the
driver (bounded size) and written by Spark into the target folder.
"""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.names import named


def stats_dict(stats: DataFrame) -> dict[str, Any]:
    """The one-row stats DataFrame as an ordered dict (field order kept)."""
    row = stats.collect()[0]
    return {k: (list(v) if isinstance(v, (list, tuple)) else v)
            for k, v in row.asDict(recursive=True).items()}


def report_kind(report_path: str) -> str:
    """``.csv`` -> csv; ``.json``, no extension or anything else -> json."""
    return "csv" if os.path.splitext(report_path)[1].lower() == ".csv" else "json"


def report_json_text(stats: dict[str, Any]) -> str:
    """A5: indent 2, non-ASCII kept, keys in record order."""
    return json.dumps(stats, indent=2, ensure_ascii=False)


def report_csv_frame(stats: DataFrame) -> DataFrame:
    """The stats row with list fields as JSON text (pinned P10)."""
    cols = []
    for f in stats.schema.fields:
        c = named(f.name)
        cols.append((F.to_json(c) if f.dataType.typeName() == "array" else c.cast("string")).alias(f.name))
    return stats.select(*cols)


def write_report(spark: SparkSession, stats: DataFrame, report_path: str) -> str:
    """Write the report into folder ``report_path``; returns the kind written."""
    kind = report_kind(report_path)
    if kind == "csv":
        (report_csv_frame(stats).coalesce(1).write.mode("overwrite")
         .options(header="true", quote='"', escape='"', nullValue="").csv(report_path))
    else:
        text = report_json_text(stats_dict(stats))
        spark.createDataFrame([Row(value=text)]).coalesce(1).write.mode("overwrite").text(report_path)
    return kind
