"""Stateless cell rules on a streaming source (memory sink, processAllAvailable)."""

import os
import shutil

from txnclean.streaming.cells_stream import clean_stream

from conftest import DATA


def test_clean_stream_matches_batch_cells(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    shutil.copy(os.path.join(DATA, "messy_transactions.csv"), os.path.join(src, "a.csv"))
    stream = (spark.readStream.schema("date string, description string, amount string")
              .options(header="true", quote='"', escape='"').csv(src))
    q = (clean_stream(stream).writeStream.format("memory").queryName("cleaned_stream")
         .outputMode("append").option("checkpointLocation", os.path.join(scratch, "ck")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = sorted((r.date or "", r.description or "", r.amount) for r in spark.table("cleaned_stream").collect())
    assert rows == sorted([("2026-04-16", "Coffee Shop", 1200.0), ("2026-04-16", "coffee shop", 1200.0),
                           ("2026-04-17", "Groceries", 45.5), ("2026-04-17", "Groceries", 45.5),
                           ("", "Bad Date", 10.0), ("2026-04-18", "Empty Amount", None)])
