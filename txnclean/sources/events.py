"""Run-event log (A12): one JSON object per line, appended to a folder.

Events: ``clean_start``, ``clean_complete`` (+ stats), ``clean_csv_error``,
``sql_export_start``, ``sql_export_complete`` (+ stats). Each event is a small
metadata record; credentials in URLs are redacted before anything is written
(pinned P8).
"""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone
from typing import Any, Optional

from pyspark.sql import DataFrame, Row, SparkSession

LOGGER = "txnclean"

_URL_PASSWORD = re.compile(r"(?P<head>[a-zA-Z][a-zA-Z0-9+.\-]*://[^:/@\s]*:)(?P<pw>[^@\s]*)(?P<at>@)")
_PARAM_PASSWORD = re.compile(r"(?i)(?P<head>[?&;]password=)(?P<pw>[^&;\s]*)")


def redact(text: Any) -> Any:
    """Hide passwords in ``scheme://user:password@host`` and ``password=`` parameters."""
    if not isinstance(text, str):
        return text
    text = _URL_PASSWORD.sub(lambda m: m.group("head") + "***" + m.group("at"), text)
    return _PARAM_PASSWORD.sub(lambda m: m.group("head") + "***", text)


def event_line(event: str, level: str = "INFO", **fields: Any) -> str:
    payload: dict[str, Any] = {
        "timestamp": datetime.now(timezone.utc).isoformat(),
        "level": level,
        "logger": LOGGER,
        "message": event,
    }
    for k, v in fields.items():
        payload[k] = redact(v) if not isinstance(v, dict) else {a: redact(b) for a, b in v.items()}
    return json.dumps(payload, ensure_ascii=False, default=str)


def log_event(spark: SparkSession, log_dir: Optional[str], event: str, level: str = "INFO",
              **fields: Any) -> None:
    """Append one event to the JSON-lines folder ``log_dir`` (no-op when None)."""
    if not log_dir:
        return
    line = event_line(event, level, **fields)
    spark.createDataFrame([Row(value=line)]).coalesce(1).write.mode("append").text(log_dir)


def read_events(spark: SparkSession, log_dir: str) -> DataFrame:
    return spark.read.json(log_dir)
