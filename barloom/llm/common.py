"""Small helpers shared by the operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

__all__ = ["BLANKS", "arrow_rows", "arrow_schema", "cut_lineage", "grow_components", "in_order", "partitions", "table", "whole", "written"]

#: The white space that separates words: space and the control characters 9 to 13.
BLANKS = "[ \\x09-\\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
         "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
         "array<string>": pa.list_(pa.string())}


def arrow_schema(fields: str) -> pa.Schema:
    """Arrow schema of "name type, ..." as task functions return it."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def arrow_rows(fields: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = arrow_schema(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: ``spark.checkpoint.dir``, else the warehouse folder."""
    import uuid

    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame as a written table: a lost executor rereads files instead of replaying what came before. Unlike a checkpoint it is
    compressed, and the optimizer carries no constraints of the earlier plan along, which grow from round to round of a loop."""
    return written(df, "barloom-step")


def grow_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Components of an undirected graph: ``(node, component)`` with the smallest reachable node.

    ``nodes``: column node; ``links``: columns a, b (either direction, repeats allowed). Only linked nodes take part in
    the rounds. Each round every node takes the smallest label among itself and its neighbours, then the label of its
    label (pointer jumping), so rounds grow with the logarithm of the diameter. A round is written: a lost executor
    replays one round. Messages to a node are combined before the exchange; nothing is gathered on the driver but the
    count of changed labels.
    """
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .filter("a <> b").distinct())
    tasks = max(4, both.count() // 100_000)  # of a written round; few links need few files
    label = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                        .select("node", F.least("node", "m").alias("component")).coalesce(tasks))
    while True:
        near = (both.join(label, both.b == label.node).groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("near")))
        step = label.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        up = step.select(F.col("node").alias("low"), F.col("low").alias("jump"))
        step = cut_lineage(step.join(up, "low", "left").select(
            "node", F.col("component").alias("old"), F.least("low", F.coalesce("jump", "low")).alias("component")).coalesce(tasks))
        label = step.select("node", "component")
        if step.filter("old <> component").isEmpty():
            break
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _running(batches):
    """Sorted rows of a task with their number and the running sum of ``_value`` before each, both within the task."""
    import numpy as np
    from pyspark import TaskContext

    part, number, total = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n, value = batch.num_rows, batch.column("_value").to_numpy(zero_copy_only=False)
        after = total + np.cumsum(value)
        for name, column in (("_part", np.full(n, part, np.int64)), ("_at", number + np.arange(n)), ("_sum", after - value)):
            batch = batch.append_column(name, pa.array(column, pa.int64()))
        number, total = number + n, int(after[-1]) if n else total
        yield batch


def in_order(df: DataFrame, *order: Column, value: Column | None = None) -> DataFrame:
    """The rows, written in a total order, with their number in it from 0 (``place``) and the sum of ``value`` over all rows before (``before``).

    One range exchange. Rows are numbered inside the sorted partitions; the sizes of the partitions (as many rows as there are
    partitions) give the offsets. The order must decide between any two rows that differ, so that a replayed task gives the same answer.
    """
    sorted_ = df.withColumn("_value", F.lit(0).cast("long") if value is None else value.cast("long")).orderBy(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema)
    spread = cut_lineage(sorted_.mapInArrow(_running, f"{schema}, _part long, _at long, _sum long"))
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # over a row per partition
    offsets = (spread.groupBy(F.col("_part").alias("p")).agg(F.count("*").alias("n"), F.sum("_value").alias("s"))
               .select("p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("_s")))
    out = (spread.join(F.broadcast(offsets), F.col("_part") == F.col("p"))
           .withColumns({"place": F.col("_at") + F.col("_n"), "before": F.col("_sum") + F.col("_s")}).drop("_value", "_part", "_at", "_sum", "p", "_n", "_s"))
    return out.drop("before") if value is None else out
