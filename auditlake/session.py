"""Session helpers: checkpoints, joins of growing tables, numbering of a sorted table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def remembered(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the columns that a function of hashable arguments builds: a large one takes thousands of
    calls into the JVM, and says the same over every table."""
    kept = lru_cache(256)(lambda jvm, *args: build(*args))
    return wraps(build)(lambda *args: kept(id(SparkContext._gateway), *args))


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session may get its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="auditlake-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def materialized(df: DataFrame) -> DataFrame:
    """Write a result once that several later steps read, so the texts are scanned once.
    The copy lies in the shared checkpoint folder and survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``materialized`` in columns, where repeated texts take little room; the copy keeps no order."""
    folder = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def sized_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join two sides that both grow with the data. A size estimate does not see how far a
    scan multiplies its rows, so neither side may be broadcast on one; sort-merge spills and
    lets adaptive execution split a skewed key."""
    return left.join(right.hint("merge"), on, how)


def numbered(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """1-based position of each row in the total order ``keys``, without sorting on one task.

    Rows travel once: they are range-partitioned, sorted in their range and checkpointed, which
    fixes the range and the place of each row in it. A position is that place plus the sizes of
    the ranges before; only one row per range goes into the offset table. Ranges are found by a
    first pass over the rows, which are written before it, so that they are worked out once."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = written(df.select("*", *[k.alias(n) for n, k in zip(names, keys)]))
    ranged = keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names).withColumn(
        "_range", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_offset"))
    # the lower 33 bits count the rows of a partition
    placed = ranged.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return (placed.join(F.broadcast(offsets), "_range")
            .withColumn(name, (F.col("_place") + F.col("_offset") + 1).cast("bigint")).drop("_range", "_place", "_offset"))
