"""Incremental scan: files that arrive in a folder or table are detected as a stream and
merged per micro-batch. A file arrives whole, so its merge never spans batches.

A folder's arrivals go through a list of names: the lister of the batch source adds the files that the
list does not hold yet, and the stream reads that list, so it sees the same files as the batch
scan, hidden and empty ones too, and Spark's own offsets tell which names are done.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dims import ALL_EXTENSIONS, SKIP_DIRS
from ..operators.merge import scan
from ..session import materialized, sized_join
from ..sources.files import list_files, open_store, read_listed, spread

NAMES = "path string, length bigint, modified bigint, error string"


def add_arrivals(spark: SparkSession, folder: str, names: str, extensions: Sequence[str] = ALL_EXTENSIONS,
                 skip_dirs: Sequence[str] = SKIP_DIRS, store: Callable = open_store) -> None:
    """Append the files below ``folder`` that the list in the folder ``names`` does not hold, or holds
    in another state, as one write. A run that fails leaves the list as it was."""
    listed = list_files(spark, folder, extensions, skip_dirs, store)
    state = [F.col(c) for c in ("path", "length", "modified")]
    key = F.sha2(F.concat_ws("\0", *[F.coalesce(c.cast("string"), F.lit("-")) for c in state]), 256)
    empty = spark.createDataFrame([], NAMES)
    target = spark._jvm.org.apache.hadoop.fs.Path(names)
    known = empty
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        known = spark.read.schema(NAMES).parquet(names)
    else:
        empty.write.parquet(names)
    fresh = materialized(sized_join(listed.withColumn("_key", key), known.select(key.alias("_key")), "_key", "left_anti"))
    if not fresh.isEmpty():  # an empty write would be a batch of its own
        fresh.select("path", "length", "modified", "error").write.mode("append").parquet(names)


def read_arriving(spark: SparkSession, folder: str, names: str, extensions: Sequence[str] = ALL_EXTENSIONS,
                  skip_dirs: Sequence[str] = SKIP_DIRS, store: Callable = open_store, max_lists: int = 100) -> DataFrame:
    """Source files that arrive below ``folder`` as a stream: file_path, language, code, error.
    ``names`` is the folder of the list; call ``add_arrivals`` again to take up later files."""
    add_arrivals(spark, folder, names, extensions, skip_dirs, store)
    arriving = spark.readStream.schema(NAMES).option("maxFilesPerTrigger", max_lists).parquet(names)
    return read_listed(spread(arriving), store)


def scan_stream(files: DataFrame, output: str, checkpoint: str, minimum: str = "low") -> StreamingQuery:
    """Write the merged findings of each micro-batch to its own folder, so that a batch that
    is run again after a failure replaces its earlier output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        scan(batch, minimum).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
