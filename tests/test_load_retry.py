"""JDBC loads are all or nothing, whatever happens to their tasks (in-process Derby)."""

import os
import subprocess
import sys
import textwrap
import uuid

import pytest
from pyspark.sql import functions as F

from txnclean.sources.jdbc_sink import Target, connection, publish, resolve_target, stage_rows, write_table

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def target(table="fr"):
    return resolve_target(f"jdbc:derby:memory:r{uuid.uuid4().hex[:8]};create=true", table, properties=DERBY)


def rows_of(spark, t, table=None):
    return spark.read.format("jdbc").option("url", t.url).option("dbtable", table or t.table).options(**DERBY).load()


def tables(spark, t):
    with connection(spark, t) as con:
        found, out = con.getMetaData().getTables(None, "APP", "%", None), []
        while found.next():
            out.append(found.getString("TABLE_NAME").lower())
        return out


def frame(spark, lo, hi, parts=4):
    return spark.range(lo, hi, 1, parts).select("id", F.concat(F.lit("row "), F.col("id").cast("string")).alias("Mixed Case"))


def failing(spark):
    """Fails in one partition after most of its rows."""
    return frame(spark, 1000, 5000).withColumn("id", F.when(F.col("id") == 2990, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))


@pytest.mark.parametrize("truncate", [False, True])
def test_a_failed_load_leaves_the_table_as_it_was(spark, truncate):
    t = target()
    write_table(frame(spark, 0, 100), t)
    with pytest.raises(Exception, match="lost"):
        write_table(failing(spark), t, truncate=truncate, batch_size=10)
    got = rows_of(spark, t)
    assert got.count() == 100 and got.columns == ["id", "Mixed Case"]
    assert tables(spark, t) == ["fr"]                          # no staging table is left
    assert write_table(frame(spark, 500, 530), t, truncate=truncate) == 30
    assert rows_of(spark, t).count() == (30 if truncate else 130)


def test_rows_of_a_repeated_attempt_count_once(spark):
    """Two attempts of each partition reached the staging table, one of them in part."""
    t = target()
    write_table(frame(spark, 0, 10), t)
    stage_rows(frame(spark, 0, 1000), t, "fr_stage")
    stage_rows(frame(spark, 0, 1000).where("id % 250 < 100"), t, "fr_stage")
    stage_rows(frame(spark, 0, 1000), t, "fr_stage")
    assert publish(spark, t, "fr_stage", ["id", "Mixed Case"], truncate=True) == 1000
    got = rows_of(spark, t)
    assert got.count() == 1000 and got.select("id").distinct().count() == 1000


def test_a_load_id_is_loaded_once(spark):
    t = target()
    assert write_table(frame(spark, 0, 50), t, load_id="a") == 50
    assert write_table(frame(spark, 0, 50), t, load_id="a") == 0
    assert write_table(frame(spark, 0, 50), t, load_id="b") == 50
    assert rows_of(spark, t).count() == 100
    with pytest.raises(Exception, match="lost"):
        write_table(failing(spark), t, load_id="c")
    assert write_table(frame(spark, 0, 7), t, load_id="c", truncate=True) == 7
    assert rows_of(spark, t).count() == 7


def test_publishing_is_one_transaction(spark):
    """The insert fails after the table was emptied: it is full again."""
    t = target()
    write_table(frame(spark, 0, 20), t)
    stage_rows(spark.range(5).select("id", F.lit("x").alias("other")), t, "fr_bad")
    with pytest.raises(Exception):
        publish(spark, t, "fr_bad", ["id", "other"], truncate=True)
    assert rows_of(spark, t).count() == 20


def test_empty_input_makes_the_table(spark):
    t = target()
    assert write_table(frame(spark, 0, 0), t) == 0
    assert rows_of(spark, t).count() == 0


def test_retried_tasks_insert_their_rows_once(scratch):
    """A session that retries tasks: one task fails mid-write at its first attempt."""
    code = textwrap.dedent(f"""
        import os, sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from txnclean.sources.jdbc_sink import resolve_target, write_table
        spark = (SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false")
                 .config("spark.sql.warehouse.dir", {scratch!r}).getOrCreate())
        spark.sparkContext.setLogLevel("OFF")

        def run(batches):
            task = TaskContext.get()
            for b in batches:
                for lo in range(0, b.num_rows, 100):
                    yield b.slice(lo, 100)
                    if task.partitionId() == 1 and task.attemptNumber() == 0 and lo >= 300:
                        raise RuntimeError("lost")

        t = resolve_target("jdbc:derby:memory:retry;create=true", "fr", properties={DERBY!r})
        for truncate, want in ((False, 2000), (True, 2000), (False, 4000)):
            n = write_table(spark.range(0, 2000, 1, 3).mapInArrow(run, "id long"), t, truncate=truncate, batch_size=10)
            got = spark.read.format("jdbc").option("url", t.url).option("dbtable", "fr").options(**{DERBY!r}).load()
            assert n == 2000 and got.count() == want and got.distinct().count() == 2000, (n, got.count())
        print("DONE")
        spark.stop()
    """)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=scratch)
    assert "DONE" in done.stdout, done.stderr[-2000:]
