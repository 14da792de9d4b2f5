"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans rely on: AQE coalesces small shuffles and splits skewed join partitions.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # text work is heavy per byte, so small shuffles should still use all cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64kb",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", memory: str = "16g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lintfleet")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: `spark.checkpoint.dir`, or a local one when unset (tests only)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="lintfleet-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spreads an input that comes in fewer splits than there are cores; a large one is left as it is.

    Only the plan is looked at. Meant for scans right before heavy work on each row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def dealt(df: DataFrame, *keys: str, rows: int) -> DataFrame:
    """Deals rows that are small but costly out to tasks of about `rows` rows, however many splits their scan has.

    A file of few row groups leaves most of its splits empty, and a table that grows should get more tasks, not longer ones.
    """
    return df.repartition(tasks_for(df, rows), *keys)


SORTED_ROWS = 100_000  # rows of a script's findings or statements: a task holds two sorts of them, of some 100 MB each


def tasks_for(df: DataFrame, rows: int = SORTED_ROWS) -> int:
    """How many tasks of about `rows` rows a scan or a written table makes, at least one per core; it is counted.

    Shuffles sized by their bytes hide how much memory rows take that compress well: tasks then sort more than they can hold.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a result that several jobs read, as a table that survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
