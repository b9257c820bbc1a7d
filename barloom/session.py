"""Session settings and the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # for readers: nanosecond dates of dataframe libraries, and GBK text
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.sql.legacy.javaCharsets": "true",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Session with the settings the operators are tuned for; a cluster session may be used as it is."""
    builder = SparkSession.builder.appName("barloom")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by ``spark.checkpoint.dir``.

    Iterative jobs call this so that a lost executor replays one step, not the whole loop. Without that setting the
    folder is one below the warehouse, which all executors share too.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def in_buckets(df: DataFrame, *keys: str) -> DataFrame:
    """The rows written in buckets of the keys, below the checkpoint folder, and read back.

    A step of a loop that joins or groups by all the keys finds these rows in place; only its other side travels. Rows are exchanged
    here, once; a caller whose rows lie by ``spark.sql.shuffle.partitions`` hash partitions of the keys already uses ``write_buckets``.
    """
    return write_buckets(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys), *keys)


def write_buckets(df: DataFrame, *keys: str) -> DataFrame:
    spark = df.sparkSession
    name = f"barloom_{uuid.uuid4().hex}"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(tasks, *keys).option("path", f"{_checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return context.getCheckpointDir()
