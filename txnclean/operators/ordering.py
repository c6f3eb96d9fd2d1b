"""Dense 0-based arrival index (A3 "dense index only when asked for").

A window ``row_number()`` over the whole table would put every row into one task.
Instead: range-partition and sort by the order column, fix that layout with a
checkpoint, count rows per partition (one small row per partition), turn the counts
into offsets on the driver (bounded by the partition count, not the data), join them as a
table of that size and add ``offset + position in partition``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

PID, MONO = "__tc_pid", "__tc_mono"


def with_dense_index(df: DataFrame, ord_col: str, name: str = "idx") -> DataFrame:
    laid = cut_lineage(df.repartitionByRange(ord_col).sortWithinPartitions(ord_col)
                       .withColumn(PID, F.spark_partition_id())
                       .withColumn(MONO, F.monotonically_increasing_id()))
    counts = laid.groupBy(PID).agg(F.count(F.lit(1)).alias("n"), F.min(MONO).alias("m0")).collect()
    if not counts:
        return laid.withColumn(name, F.lit(None).cast("long")).drop(PID, MONO)
    shifts, run = [], 0
    for pid, n, m0 in sorted((r[PID], r["n"], r["m0"]) for r in counts):
        shifts.append((pid, run - m0))
        run += n
    # one row a partition: joined, so that the expression does not grow with them
    table = laid.sparkSession.createDataFrame(shifts, f"{PID} int, __tc_shift long")
    return laid.join(F.broadcast(table), PID).withColumn(name, F.col(MONO) + F.col("__tc_shift")).drop(PID, MONO, "__tc_shift")
