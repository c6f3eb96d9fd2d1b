"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  checkpoint_dir: str | None = None,
                  warehouse_dir: str | None = None) -> SparkSession:
    """A local session configured like the tests and the bench (UI off, AQE on)."""
    builder = SparkSession.builder
    if warehouse_dir:
        builder = builder.config("spark.sql.warehouse.dir", warehouse_dir)
    spark = (
        builder.master(f"local[{cores}]")
        .appName("txnclean")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", os.environ.get("TXNCLEAN_CLEAN_CHECKPOINTS", "true"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Generated methods above 8000 bytes are never JIT-compiled by HotSpot; the
        # date and amount rules make large stages, so let Spark split those instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # the registered queries read single small files: deal them out over the cores
        .config("spark.txnclean.inputPartitions", str(os.cpu_count() if cores == "*" else cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TXNCLEAN_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, checkpoint_dir)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the session names none and runs in local mode (tests) is ``fallback`` used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    # a machine-local fallback folder is only acceptable when everything runs locally
    local = sc.master.startswith("local")
    target = conf or (fallback if local else None)
    if not target:
        raise RuntimeError("spark.checkpoint.dir is not set; ghost removal needs a shared "
                           "checkpoint folder to cut lineage between rounds")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir()


#: Whether the shuffle files of a query are removed when it ends (Spark makes them anew if they are asked for again).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss). What was shuffled for it is not read again
    and leaves the disk at once, not when the driver next collects garbage."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        own = df.select("*")        # a query of its own: df's may be run again
        return own.checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def release(df: DataFrame) -> None:
    """Removes the files of a frame that ``cut_lineage`` returned, once nothing reads it or what was made from it any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
