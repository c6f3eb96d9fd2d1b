"""CSV scan with header checks and an arrival-order column."""

from __future__ import annotations

from typing import Optional

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import named
from .csv_ranges import longest_file, read_csv_ranges

ORD = "_ord"

# RFC 4180 quoting: a doubled quote escapes a quote (Spark's default escape is a
# backslash, which would misread such files).
CSV_OPTIONS = {"header": "true", "inferSchema": "false", "quote": '"', "escape": '"',
               "encoding": "UTF-8"}


def read_header(spark: SparkSession, path: str, multi_line: bool = True) -> list[str]:
    """A2: the raw header cells, stripped. Raises ValueError when there is no header."""
    try:
        head = (spark.read.options(**{**CSV_OPTIONS, "header": "false"})
                .option("multiLine", str(multi_line).lower()).csv(path).limit(1).collect())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(path) from e
        raise
    if not head:
        raise ValueError("CSV header not found (malformed or empty CSV).")
    names = [("" if v is None else v).lstrip("\ufeff").strip() for v in head[0]]
    if len(set(names)) != len(names):
        raise ValueError(f"Duplicate column names in CSV header: {names}")  # pinned P2
    return names


def _split_bytes(spark: SparkSession) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")))


def read_csv(spark: SparkSession, path: str, multi_line: bool = True, ranges: Optional[bool] = None) -> DataFrame:
    """A1 + A3: all cells as nullable strings, header names stripped, plus ``_ord``.

    ``_ord`` = (file path, split start, position in the split) is taken straight
    after the scan, before any shuffle, so "first row wins" means file order however
    the data is later partitioned. It is deterministic, so a re-run task after an
    executor loss produces the same values.
    ``multi_line=True`` allows quoted newlines. A file larger than a split is then read in byte
    ranges by all cores (``csv_ranges.py``; the same rows and ``_ord``), a smaller one as one split;
    ``ranges`` forces either. ``multi_line=False`` lets Spark split huge files that have no quoted newlines.
    """
    header = read_header(spark, path, multi_line)
    if multi_line and ranges is None:
        ranges = longest_file(spark, path) > _split_bytes(spark)
    if multi_line and ranges:
        return read_csv_ranges(spark, path, header, CSV_OPTIONS, ORD)
    df = (spark.read.options(**CSV_OPTIONS).option("multiLine", str(multi_line).lower())
          .csv(path))
    if len(df.columns) != len(header):
        raise ValueError(f"CSV header could not be read consistently: {df.columns}")
    df = df.toDF(*header)
    return df.select(
        F.struct(F.col("_metadata.file_path").alias("file"),
                 F.col("_metadata.file_block_start").alias("start"),
                 F.monotonically_increasing_id().alias("pos")).alias(ORD),
        *[named(c) for c in header],
    )
