"""One large CSV file with quoted line breaks, read by all cores (A1, A3).

The file is scanned in byte ranges as physical lines. Whether a line starts inside a quoted field depends
on all lines before it, but a line maps either state to a state, so a range does too:

1. each range reports its end state and its number of records for both states it may start in (four
   numbers a range; the driver lays them end to end and sees no rows);
2. each range is read again from its true state: lines are put together to records, numbered from the
   file's start, and parsed by the built-in CSV parser. Only records that cross a border of ranges
   are put together by a shuffle.

A quote opens a field only where the field starts; a doubled quote inside does not close it. A field that is
never closed reaches to the file's end (without its last line break).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# A line that, started outside quotes, ends inside: whole fields, then one that opens and does not close.
_CLOSED = r'"(?:[^"]++|"")*+"[^,]*+'
_ENDS_INSIDE = rf'(?s)\A(?:(?:{_CLOSED}|[^",][^,]*+)?+,)*+"(?:[^"]++|"")*+\z'


def longest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file (names and lengths are listed, nothing is read)."""
    row = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()
    return int(row[0] or 0)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the range), line, and the state after the line by the state before it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value")
    quoted = F.contains(line, F.lit('"'))
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), line.alias("line"),
        F.when(quoted, line.rlike(_ENDS_INSIDE)).otherwise(False).alias("from_outside"),
        F.when(quoted, F.concat(F.lit('"'), line).rlike(_ENDS_INSIDE)).otherwise(True).alias("from_inside"))


def _blank(line: str) -> bool:
    return line == "" or line == "\r"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: for either state at its start, whether it ends inside and how many records start in it."""
    at, states, counts = None, [False, True], [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [at[0]], "start": [at[1]], "e0": [states[0]], "e1": [states[1]], "n0": [counts[0]], "n1": [counts[1]]})

    for b in batches:
        for file, start, line, outside, inside in zip(*[b.column(k).to_pylist() for k in range(5)]):
            if (file, start) != at:
                if at is not None:
                    yield row()
                at, states, counts = (file, start), [False, True], [0, 0]
            for k in (0, 1):
                if states[k]:
                    states[k] = inside
                else:
                    counts[k] += not _blank(line)
                    states[k] = outside
    if at is not None:
        yield row()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their range's state, first record number and end state: (file, number, part, text). part is null for a
    whole record; else the record goes on in another range, and part is the start of this range."""
    out: list[tuple] = []
    at, inside, number, held, border, last = None, False, 0, None, False, False

    def close(crosses: bool) -> None:
        if held is not None:
            text = "\n".join(held)
            out.append((at[0], number, at[1] if crosses else None, text))

    for b in batches:
        for file, start, line, outside_, inside_, state, first, ends in zip(*[b.column(k).to_pylist() for k in range(8)]):
            if (file, start) != at:
                close(border or last)
                at, inside, number, last = (file, start), state, first - 1, ends
                held, border = ([], True) if state else (None, False)
            if inside:
                held.append(line)
                inside = inside_
            else:
                close(border)
                held, border = None, False
                if not _blank(line):
                    number, held = number + 1, [line]
                inside = outside_
        if out:
            yield _batch(out)
            out.clear()
    close(border or last)
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                       pa.array(cols[3], pa.string())], names=["file", "number", "part", "text"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 0, blank lines not counted), text: the records of each file, as they stand."""
    lines = _lines(spark, path)
    found = lines.mapInArrow(_ranges, "file string, start long, e0 boolean, e1 boolean, n0 long, n1 long").collect()
    table, file, inside, count = [], None, False, 0
    for r in sorted(found, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, inside, count = r["file"], False, 0
        ends = r["e1"] if inside else r["e0"]
        table.append((file, r["start"], inside, count, ends))
        count += r["n1"] if inside else r["n0"]
        inside = ends
    if not table:
        return spark.createDataFrame([], "file string, number long, text string")
    # a row for each range, not for data: joined to the lines, which keep their order
    known = spark.createDataFrame(table, "file string, start long, state boolean, first long, ends boolean")
    got = lines.join(F.broadcast(known), ["file", "start"]).select(
        "file", "start", "line", "from_outside", "from_inside", "state", "first", "ends").mapInArrow(_records, "file string, number long, part long, text string")
    whole = got.where("part is null").select("file", "number", "text")
    if not any(t[2] or t[4] for t in table):
        return whole                                # no record crosses a border, and none is left open
    crossing = (got.where("part is not null").groupBy("file", "number")
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "\n").alias("text")))
    return whole.unionByName(crossing)


def read_csv_ranges(spark: SparkSession, path: str, header: list[str], options: dict, ord_col: str) -> DataFrame:
    """The same cells and order column as the one-task multi-line scan of each file."""
    # lines end as the header's does
    first = spark.read.option("lineSep", "\n").text(path).select("value").first()
    text = F.col("text")
    if first is not None and first[0].endswith("\r"):
        text = F.regexp_replace(text, r"\r\z", "")
    names = [f"c{i}" for i in range(len(header))]
    parsed = F.from_csv(text, ", ".join(f"{n} string" for n in names),
                        {**{k: v for k, v in options.items() if k not in ("header", "inferSchema")}, "multiLine": "true"})
    rows = read_records(spark, path).where(F.col("number") > 0).select("file", "number", parsed.alias("row"))
    return rows.select(
        F.struct(F.col("file"), F.lit(0).cast("long").alias("start"), (F.col("number") - 1).alias("pos")).alias(ord_col),
        *[F.col("row")[n].alias(h) for n, h in zip(names, header)])
