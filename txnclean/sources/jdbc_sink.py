"""Table sinks (A8-A11): JDBC (any dialect Spark ships) or a catalog table.

* create-if-absent + append, and truncate-then-load, which keeps an existing table's definition and
  creates the table when it is absent (A9);
* batches: JDBC ``batchsize`` (default 1000, as the reference), one connection and
  transaction per partition, ``numPartitions`` bounds concurrent connections (A11);
* a JDBC load is all or nothing: tasks write to a staging table of their own load, each row marked
  with its partition and task attempt, so rows of an attempt that was repeated (an executor lost
  after its commit, a speculative copy) are told apart; one transaction then empties the table where asked
  and inserts one attempt of each partition. Until it commits, readers see the old table, and a failed load
  leaves it as it was. With a ``load_id`` the same transaction enters it in a ledger table, and
  a load that is run again under the same id inserts nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Optional
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..functions.names import quote_name


@dataclass(frozen=True)
class Target:
    kind: str                    # "jdbc" or "catalog"
    url: Optional[str] = None
    table: str = ""
    properties: dict = field(default_factory=dict)
    postgres: bool = False


def resolve_target(db_url_or_path: Optional[str], table_name: str,
                   postgres_schema: str = "public", properties: Optional[dict] = None) -> Target:
    """A10: ``postgres://``/``postgresql://`` URL -> JDBC PostgreSQL with a schema-qualified
    table; ``jdbc:...`` -> as given; ``None`` -> session catalog table; anything else is a
    SQLite file path (needs the SQLite JDBC driver on the classpath)."""
    props = dict(properties or {})
    if db_url_or_path is None:
        return Target("catalog", table=table_name)
    low = db_url_or_path.lower()
    if low.startswith(("postgres://", "postgresql://")):
        u = urlparse(db_url_or_path)
        if u.username:
            props.setdefault("user", unquote(u.username))
        if u.password:
            props.setdefault("password", unquote(u.password))
        port = f":{u.port}" if u.port else ""
        query = f"?{u.query}" if u.query else ""
        url = f"jdbc:postgresql://{u.hostname}{port}{u.path}{query}"
        props.setdefault("driver", "org.postgresql.Driver")
        return Target("jdbc", url, f"{postgres_schema}.{table_name}", props, postgres=True)
    if low.startswith("jdbc:"):
        return Target("jdbc", db_url_or_path, table_name, props)
    props.setdefault("driver", "org.sqlite.JDBC")
    return Target("jdbc", f"jdbc:sqlite:{db_url_or_path}", table_name, props)


def write_table(df: DataFrame, target: Target, *, truncate: bool = False,
                batch_size: int = 1000, num_partitions: Optional[int] = None,
                table_path: Optional[str] = None, column_types: Optional[dict[str, str]] = None,
                load_id: Optional[str] = None) -> Optional[int]:
    """``column_types``: inferred SQL type per column; a created JDBC table gets DATE and DOUBLE
    columns by them, text columns the dialect's own text type (no length limit). Returns the
    rows that a JDBC load inserted (0 if ``load_id`` was loaded before)."""
    if target.kind == "catalog":
        spark = df.sparkSession
        if truncate and spark.catalog.tableExists(target.table):
            df.write.insertInto(target.table, overwrite=True)  # keeps the definition
        else:
            w = df.write.mode("append")
            if table_path:
                w = w.option("path", table_path)
            w.saveAsTable(target.table)
        return None
    spark = df.sparkSession
    if load_id is not None and _loaded_before(spark, target, load_id):
        return 0
    made = {"DATE": "DATE", "FLOAT": "DOUBLE"}
    defined = ", ".join(f"{quote_name(c)} {made[t]}" for c, t in (column_types or {}).items() if t in made)
    stage = f"{target.table}_stage_{uuid.uuid4().hex[:12]}"
    try:
        stage_rows(df, target, stage, batch_size, num_partitions, defined)
        _writer(df.limit(0), target, target.table, defined).mode("append").save()     # creates the table if absent
        return publish(spark, target, stage, df.columns, truncate, load_id)
    finally:
        with connection(spark, target) as con:
            if _exists(con, stage):
                _run(con, f"DROP TABLE {stage}")


# ---------------------------------------------------------------- staging and publishing

PART, ATTEMPT = "tc_part", "tc_attempt"


def _writer(df: DataFrame, target: Target, table: str, defined: str):
    w = df.write.format("jdbc").option("url", target.url).option("dbtable", table)
    if defined:
        w = w.option("createTableColumnTypes", defined)
    for k, v in target.properties.items():
        w = w.option(k, v)
    return w


def stage_rows(df: DataFrame, target: Target, stage: str, batch_size: int = 1000,
               num_partitions: Optional[int] = None, defined: str = "") -> None:
    """Write the rows to the staging table, marked with partition and attempt."""
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([task.partitionId()] * b.num_rows, pa.int32()), pa.array([task.taskAttemptId()] * b.num_rows, pa.int64())],
                names=[*b.schema.names, PART, ATTEMPT])

    if num_partitions and df.rdd.getNumPartitions() > num_partitions:
        df = df.coalesce(num_partitions)
    schema = ", ".join(f"{quote_name(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = df.mapInArrow(marked, f"{schema}, {PART} int, {ATTEMPT} long")
    _writer(rows, target, stage, defined).option("batchsize", str(batch_size)).mode("append").save()


@contextmanager
def connection(spark: SparkSession, target: Target):
    """A JDBC connection of the driver (statements alone; no rows pass through it)."""
    jvm = spark._jvm
    if "driver" in target.properties:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(target.properties["driver"])
    props = jvm.java.util.Properties()
    for k, v in target.properties.items():
        if k != "driver":
            props.setProperty(k, str(v))
    con = jvm.java.sql.DriverManager.getConnection(target.url, props)
    try:
        yield con
    finally:
        con.close()


def _run(con, sql: str) -> int:
    statement = con.createStatement()
    try:
        return statement.executeUpdate(sql)
    finally:
        statement.close()


def _exists(con, table: str) -> bool:
    schema, _, name = table.rpartition(".")
    found = con.getMetaData().getTables(None, None, "%", None)
    while found.next():
        if found.getString("TABLE_NAME").lower() == name.lower() and (
                not schema or (found.getString("TABLE_SCHEM") or "").lower() == schema.lower()):
            return True
    return False


def _ledger(target: Target) -> str:
    return f"{target.table}_loads"


def _loaded_before(spark: SparkSession, target: Target, load_id: str) -> bool:
    with connection(spark, target) as con:
        if not _exists(con, _ledger(target)):
            _run(con, f"CREATE TABLE {_ledger(target)} (load_id VARCHAR(200) NOT NULL PRIMARY KEY, n BIGINT)")
        ask = con.prepareStatement(f"SELECT n FROM {_ledger(target)} WHERE load_id = ?")
        ask.setString(1, load_id)
        return ask.executeQuery().next()


def publish(spark: SparkSession, target: Target, stage: str, columns: list[str], truncate: bool,
            load_id: Optional[str] = None) -> int:
    """One transaction: (empty the table,) insert one whole attempt of each partition, enter the load. Returns the rows inserted."""
    sizes = (spark.read.format("jdbc").option("url", target.url).options(**target.properties)
             .option("query", f"SELECT {_quoted(spark, target, PART)} AS p, {_quoted(spark, target, ATTEMPT)} AS a, COUNT(*) AS n "
                              f"FROM {stage} GROUP BY {_quoted(spark, target, PART)}, {_quoted(spark, target, ATTEMPT)}")
             .load().collect())                # a row for each partition and attempt
    best: dict[int, tuple[int, int]] = {}
    for p, a, n in sizes:                      # the job succeeded, so the largest attempt of a partition is whole
        best[p] = max(best.get(p, (0, 0)), (n, a))
    names = ", ".join(_quoted(spark, target, c) for c in columns)
    with connection(spark, target) as con:
        con.setAutoCommit(False)
        try:
            for p, a, _ in sizes:
                if best[p][1] != a:
                    _run(con, f"DELETE FROM {stage} WHERE {_quoted(spark, target, PART)} = {p} AND {_quoted(spark, target, ATTEMPT)} = {a}")
            if truncate:
                _run(con, f"DELETE FROM {target.table}")
            rows = _run(con, f"INSERT INTO {target.table} ({names}) SELECT {names} FROM {stage}")
            if load_id is not None:
                enter = con.prepareStatement(f"INSERT INTO {_ledger(target)} (load_id, n) VALUES (?, ?)")
                enter.setString(1, load_id)
                enter.setLong(2, rows)
                enter.executeUpdate()
            con.commit()
        except Exception:
            con.rollback()
            raise
    return rows


def _quoted(spark: SparkSession, target: Target, name: str) -> str:
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(target.url).quoteIdentifier(name)
