"""Scratch tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from txnclean.session import ensure_checkpoint_dir


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one only where it is unset (tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    ensure_checkpoint_dir(spark, "/tmp/txnclean-checkpoints")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (long) and text (string) alone; columns that are so already are not renamed, so that equal scans stay equal plans."""
    types = dict(docs.dtypes)

    def one(have: str, want: str, kind: str):
        col = F.col(f"`{have}`")
        return col if have == want and types[have] == kind else col.cast(kind).alias(want)

    return docs.select(one(id_col, "doc_id", "bigint"), one(text_col, "text", "string"))


def sample_rows(df: DataFrame, n: int) -> DataFrame:
    """At most n different rows, those of the smallest hashes. Only hashes are ranked, never whole rows in one task."""
    keyed = df.withColumn("_key", F.xxhash64(*df.columns))
    keys = keyed.select("_key").orderBy("_key").limit(n).distinct()         # n hashes at most: may be broadcast
    return keyed.join(F.broadcast(keys), "_key").dropDuplicates(["_key"]).drop("_key")


def free_name(df: DataFrame, want: str) -> str:
    """``want``, or with more underscores before it, so that no column of df has the name in any case."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want = "_" + want
    return want
