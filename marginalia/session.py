"""Session helpers shared by the entry points, the benchmark and the tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str | int = "*", memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marginalia")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, a single machine) a temporary folder stands in.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="marginalia-"))
    return context.getCheckpointDir().rstrip("/")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Give row-local work enough tasks when the scan alone has too few.

    A small table may be one file with one row group, which one task would read and process alone.
    At scale the scan already has at least as many splits as the cluster has slots, and nothing is
    shuffled. Keys should be unique ids, so that no task gets a hot key.
    """
    slots = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= slots:
        return rows
    return rows.repartition(slots * 2, *keys)
