"""What several operators share: tables in the shared folder, word counts, running sums over a
sorted table, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where set, ``stored`` notes what it writes there, for ``forget``.
WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)
WORD = r"[^\x20\x09-\x0D]+"
#: A term is a longest run of ASCII letters, digits and all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SPACES = " \t\n\x0b\x0c\r"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a local session that
    names none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="auditlake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write a result once as a table in the shared folder and go on from there: later steps
    neither repeat the work nor depend on the executors that did it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    if (made := WRITTEN.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(parts: Iterable[DataFrame]) -> DataFrame:
    """Like ``stored`` for results with one schema, which are written one after the other into one table."""
    path = schema = None
    for df in parts:
        if path is None:
            path, schema = f"{shared_folder(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}", df.schema
            if (made := WRITTEN.get()) is not None:
                made.append(path)
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``stored`` wrote and that nothing reads any more."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sum(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group up to and with this one.

    Rows are range-partitioned by group and order and written once, so that a group, however
    large, is spread over as many ranges as it needs. A range then adds what the ranges before
    hold of its group. Rows that tie in the whole order may swap places."""
    keys = [*groups, *order]
    ranged = stored(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*groups, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*groups).orderBy("_range")
    offsets = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_r"),
                            (F.sum("_total").over(before) - F.col("_total")).alias("_offset"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*groups, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.join(offsets, same).withColumn(name, F.sum(value).over(inside) + F.col("_offset"))
            .drop("_range", "_r", "_offset", *[f"_g{i}" for i in range(len(groups))]))


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of the text column each, one row at least."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        out[done:2 * done] = out[:min(done, n - done)] * np.uint64(step)
        step = step * step % (1 << 64)
        done *= 2
    return out


def word_hashes(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a column, in order; a null text has none. ``table`` says what a
    byte counts as; blanks (32) end a word.

    A word's hash is its polynomial over the bytes, taken from running sums over the whole column,
    so no word becomes an object and nothing is remembered."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    size = int(ends[-1] - ends[0]) if len(texts) else 0
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    raw = np.frombuffer(table, np.uint8)[raw]
    ends = ends - ends[0]
    inside = raw != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[ends[:-1][ends[:-1] < size]] |= inside[ends[:-1][ends[:-1] < size]]
    begin = np.flatnonzero(first)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:]
    end = np.flatnonzero(stop) + 1
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(BASE, size), out=sums[1:])
    hashes = (sums[end] - sums[begin]) * _powers(INVERSE, size)[begin]
    return mix(hashes), np.searchsorted(ends, begin, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def find(parent: dict, x):
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while (up := parent.get(x, x)) != root:
        parent[x] = root
        x = up
    return root


NODES = 1 << 18  # nodes whose trees a task holds at once, and edges of a task


def _trees(parent: dict[int, int]) -> pa.RecordBatch:
    pairs = [(x, root) for x in parent if (root := find(parent, x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges that a task reads by one edge for each node to the smallest of its tree; trees
    go out and begin anew when they hold very many nodes."""
    parent: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(*(batch.column(k).to_numpy().tolist() for k in (0, 1))):
            a, b = find(parent, u), find(parent, v)
            parent[max(a, b)] = min(a, b)
        if len(parent) > NODES:
            yield _trees(parent)
            parent = {}
    yield _trees(parent)


def components(links: DataFrame) -> DataFrame:
    """Connected components of the links ``u, v`` (long): every linked node with its smallest
    reachable node, as ``node, component``.

    Links are thinned to forests task by task, and again with a task for every NODES edges that are
    left, so that few links do not stay apart in many tasks. What is left points from larger to smaller nodes. A node with one goal, which points
    nowhere, is settled; for the others, all goals point at the smallest one (small star) and what
    points at the node points there as well (large star), until all are settled. The open nodes are
    a minimum and a maximum per node, which combine before the shuffle; they get fewer from round
    to round, and a join with many of them is one that adaptive execution can split at a hot node."""
    forest = lambda edges: stored(edges.mapInArrow(_forest, "u bigint, v bigint"))
    dealt = lambda edges, size: edges.coalesce(1 + size // NODES)
    ends = lambda *pairs: F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs])
    edges = forest(links.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).where("u != v"))
    edges = forest(dealt(edges, edges.count()))
    while True:
        goals = edges.select(F.inline(ends(("u", "v"), ("v", "v"))))
        labels = stored(goals.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"), F.max("v").alias("most")))
        unsettled = labels.where("component < most")
        if unsettled.isEmpty():
            return labels.select("node", "component")
        least = lambda key: unsettled.select(F.col("node").alias(key), F.col("component").alias("least"))
        small = edges.join(least("u"), "u", "left").select(F.inline(
            F.when(F.col("least").isNull(), ends(("u", "v"))).otherwise(ends(("u", "least"), ("v", "least"))))).where("u != v")
        large = small.join(least("v"), "v", "left").select("u", F.coalesce("least", "v").alias("v"))
        edges = forest(dealt(large, edges.count()))
