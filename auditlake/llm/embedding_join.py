"""Operator 4: near-duplicate embeddings by the epsilon grid order join.

Vectors are scaled to length 1, where a cosine is a distance, and turned to their principal
dimensions. Per label they are sorted by grid cells of the joining distance on the leading
dimensions, and the sorted sequence is cut into intervals with a bounding box. The sorted table is
written once and never shuffled again: the intervals are broadcast some at a time, and in each
round every task takes those it reads through the intervals broadcast. A tree over the boxes skips
what lies farther apart than the distance; what is left is sieved in single precision with room
for its error and decided in double precision. Equal vectors are one, with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, NODES, components, find, gathered, stored

LEADING = 6  # principal dimensions with grid cells
BOXED = 12  # principal dimensions with bounding boxes
BLOCK = 256  # vectors in the smallest interval
FANOUT = 8  # intervals in one of the next level
AT_ONCE = 32 << 20  # bytes of vectors that are broadcast in a round
COLUMNS = 4096  # vectors compared with an interval at once
FILE = 32 << 20  # bytes of vectors in a range of the sorted table, at most
TASKS = 8  # tasks that add up products for the axes


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fine(vector: str) -> Column:
    """Whether a vector has finite components only and not just zeros."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(vectors: DataFrame, length: int, share: float) -> np.ndarray:
    """Principal axes of the unit vectors as columns, the widest first. They only say which
    intervals are worth comparing, so a ``share`` of the vectors chosen by a hash is enough: a few tasks
    each send one array of sums of products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                u = _unit(_matrix(batch.column(0)))
                total = u.T @ u if total is None else total + u.T @ u
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    chosen = vectors.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v")
    m = np.zeros((length, length))
    for part in chosen.coalesce(TASKS).mapInArrow(run, "x binary").collect():
        m += np.frombuffer(part.x).reshape(length, length)
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()


def placed(classes: DataFrame, axes: np.ndarray, width: float) -> DataFrame:
    """The classes of one length with their grid cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _unit(_matrix(batch.column("v"))) @ axes[:, :LEADING]
            cells = np.floor(p / width).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1]), pa.int32()), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "cell"])

    schema = ", ".join(f"{c} {t}" for c, t in classes.dtypes)
    return classes.mapInArrow(run, f"{schema}, cell array<int>")


def intervals(rows: DataFrame) -> DataFrame:
    """``block``, the first ``cls`` of an interval of at most BLOCK sorted rows with one label and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = size = 0
        last = None
        for batch in batches:
            labels, lengths = batch.column("label"), np.asarray(batch.column("length"))
            out, at = np.empty(batch.num_rows, np.int64), 0
            if not batch.num_rows:
                continue
            changes = np.asarray(pc.fill_null(pc.not_equal(labels.slice(1), labels.slice(0, len(labels) - 1)), True)) | (np.diff(lengths) != 0)
            for end in [*(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]:
                kind = (labels[at].as_py(), lengths[at])
                if kind != last:
                    last, size = kind, 0
                while at < end:
                    if size % BLOCK == 0:
                        block, size = batch.column("cls")[at].as_py(), 0
                    step = min(end - at, BLOCK - size)
                    out[at:at + step] = block
                    at, size = at + step, size + step
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "block"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, block bigint")


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(length, label), block, classes, counts and unit vectors of each run of rows of one block."""
    if not batch.num_rows:
        return
    blocks = np.asarray(batch.column("block"))
    edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows]
    cls, n = np.asarray(batch.column("cls")), np.asarray(batch.column("n"))
    for a, b in zip(edges, edges[1:]):
        label = batch.column("label")[a].as_py()
        yield ((batch.column("length")[a].as_py(), "nan" if label != label else label), int(blocks[a]), cls[a:b], n[a:b],
               _unit(_matrix(batch.column("v").slice(a, b - a))))


class _Side:
    """The broadcast vectors of one length and label: joined, with boxes by block and by FANOUT of these."""

    def __init__(self, pieces: list[tuple], axes: np.ndarray):
        pieces = sorted(pieces, key=lambda x: (x[1], x[2][0]))
        self.cls, self.n, self.u = (np.concatenate([x[k] for x in pieces]) for k in (2, 3, 4))
        self.block, starts = np.unique(np.repeat([x[1] for x in pieces], [len(x[2]) for x in pieces]), return_index=True)
        self.of = np.repeat(self.block, np.diff(np.append(starts, len(self.cls))))
        self.ends = np.append(starts, len(self.cls))
        self.single = self.u.astype(np.float32)
        self.links = np.zeros(len(self.cls), np.int64)
        p = self.u @ axes
        self.boxes = [(np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts))]
        while len(self.boxes[-1][0]) > FANOUT:
            lo, hi = self.boxes[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.boxes.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))

    def near(self, lo: np.ndarray, hi: np.ndarray, reach: float) -> np.ndarray:
        """Numbers of the blocks whose boxes are within reach, level by level."""
        at = np.arange(len(self.boxes[-1][0]))
        for k in range(len(self.boxes) - 1, -1, -1):
            gap = np.maximum(0, np.maximum(self.boxes[k][0][at] - hi, lo - self.boxes[k][1][at]))
            at = at[(gap * gap).sum(1) <= reach]
            if k:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.boxes[k - 1][0])]
        return at


def _turn(a: int, others: np.ndarray) -> np.ndarray:
    """Which pairs of blocks are compared where ``a`` is read: its own, and of any two blocks either
    the first or the second, so that every task has a like share."""
    mixed = (np.int64(a) ^ others).astype(np.uint64) * np.uint64(BASE) >> np.uint64(63)
    return np.where(mixed == 1, a < others, a > others) | (others == a)


def compared(rows: DataFrame, chosen: DataFrame, axes: dict[int, np.ndarray], least: float,
             reach: float) -> tuple[DataFrame, Broadcast]:
    """cls, links and root of each class linked with one of the ``chosen`` ones, which are broadcast: how many
    vectors it is linked with there and the smallest class it reaches there. No pair of vectors leaves the task."""
    sent = rows.sparkSession.sparkContext.broadcast(chosen.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list | _Side] = {}
        for batch in sent.value.to_batches():
            for piece in _pieces(batch):
                held.setdefault(piece[0], []).append(piece)
        parent: dict[int, int] = {}
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> pa.RecordBatch:
            sides = [x for x in held.values() if isinstance(x, _Side)]
            cls, links = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(
                *found, *[(x.cls[x.links > 0], x.links[x.links > 0]) for x in sides], (np.empty(0, np.int64),) * 2))
            for x in sides:
                x.links[:] = 0
            found.clear()
            roots = pa.array([find(parent, x) for x in cls.tolist()], pa.int64())
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(links), roots], ["cls", "links", "root"])

        for batch in batches:
            for kind, block, cls, n, u in _pieces(batch):
                if kind not in held:
                    continue
                turned = axes[kind[0]]
                if not isinstance(side := held[kind], _Side):
                    side = held[kind] = _Side(side, turned)
                p = u @ turned
                near = side.near(p.min(0), p.max(0), reach)
                near = near[_turn(block, side.block[near])]
                if not len(near):
                    continue
                single, links = u.astype(np.float32), np.zeros(len(cls), np.int64)
                columns = np.concatenate([np.arange(side.ends[k], side.ends[k + 1]) for k in near])
                sieve = np.float32(least - 1.2e-7 * (kind[0] + 8))  # what rounding may take from a cosine
                for low in range(0, len(columns), COLUMNS):
                    at = columns[low:low + COLUMNS]
                    maybe = single @ side.single[at].T >= sieve
                    if not maybe.any():
                        continue
                    a, b = np.flatnonzero(maybe.any(1)), at[maybe.any(0)]
                    hit = u[a] @ side.u[b].T >= least
                    hit &= (side.of[b] != block) | (cls[a][:, None] < side.cls[b])
                    if not hit.any():
                        continue
                    links[a] += hit @ side.n[b]
                    side.links[b] += n[a] @ hit
                    # a column meets its first row, and a row the first rows of its columns
                    first = hit.argmax(0)
                    left, right = cls[a].tolist(), side.cls[b].tolist()
                    met = [(left[first[j]], right[j]) for j in np.flatnonzero(hit.any(0))]
                    met += [(left[i], left[f]) for i in np.flatnonzero(hit.any(1)) for f in np.unique(first[hit[i]]) if f != i]
                    for x, y in met:
                        q, r = find(parent, x), find(parent, y)
                        parent[max(q, r)] = min(q, r)
                found.append((cls[links > 0], links[links > 0]))
            if len(parent) > NODES:
                yield told()
        yield told()

    return rows.mapInArrow(run, "cls bigint, links bigint, root bigint"), sent


def near_duplicates(vectors: DataFrame, least: float = 0.93, id: str = "vec_id", vector: str = "embedding",
                    label: str = "label", sample: int = 20_000) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links (vectors linked directly, itself not),
    component_id (smallest id reachable) and kept (whether it is that one).

    Linked are vectors of one non-null label with a cosine of ``least`` or more in double
    precision. A vector that is null, empty, zero or holds null or non-finite components links
    with nothing, nor does one without label or id. Vectors of different lengths are compared
    within their length only. Rows that share an id are one node of the components, each with the
    links of its own vector. The axes are fitted on about ``sample`` distinct vectors; all are compared."""
    if not 0 < least <= 1:
        raise ValueError("the least cosine must lie in (0, 1]")
    single = vectors.select(vectors[vector]).dtypes[0][1] == "array<float>"
    slim = vectors.select(vectors[id].cast("bigint").alias("vec_id"), vectors[vector].cast(f"array<{'float' if single else 'double'}>").alias("v"),
                          vectors[label].alias("label"))
    usable = slim.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine("v"))
    reach = 2 - 2 * least + 1e-9
    sizes = dict(usable.groupBy(F.size("v")).count().collect())
    rest = slim.where(F.col("vec_id").isNull() | F.col("label").isNull() | ~fine("v"))
    alone = rest.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    if not sizes:
        return alone.withColumn("kept", kept)
    classes, axes = sorted_classes(usable, sizes, math.sqrt(reach), sample, 4 if single else 8)
    partial = links(classes, sum(k * n for k, n in sizes.items()) * (4 if single else 8), axes, least, reach)
    counts = partial.groupBy("cls").agg(F.sum("links").alias("links"))
    rows = numbers(usable, classes, sum(sizes.values()))
    # an id with several vectors holds their classes together
    shared = rows.groupBy("vec_id").agg(F.min("cls").alias("v"), F.max("cls").alias("last")).where("v < last")
    held = rows.join(shared, "vec_id").select(F.col("cls").alias("u"), "v")
    nodes = components(partial.select(F.col("cls").alias("u"), F.col("root").alias("v")).unionByName(held))
    found = classes.select("cls", "vec_id", "n").join(counts, "cls", "left").join(nodes.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("group"))
    found = stored(found)
    least_id = found.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    linked = rows.join(found.drop("vec_id").join(least_id, "group"), "cls").select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", kept)


def key() -> Column:
    return F.xxhash64("v")


def sorted_classes(usable: DataFrame, sizes: dict[int, int], width: float, sample: int, bytes: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The distinct vectors in grid order, written once: length, label, v, vec_id (the smallest), n, key, cls and
    block; and the leading axes by length. Between two shuffles of the vectors nothing is written."""
    parts, axes = [], {}
    for length, n in sizes.items():
        own = usable.where(F.size("v") == length)
        turn = rotation(own, length, min(1.0, sample / n))
        axes[length] = turn[:, :BOXED].copy()
        classes = own.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
        parts.append(placed(classes.select(F.lit(length).alias("length"), "label", "v", "vec_id", "n"), turn, width))
    whole = reduce(DataFrame.unionByName, parts)
    ranges = max(4 * usable.sparkSession.sparkContext.defaultParallelism, sum(k * n for k, n in sizes.items()) * bytes // FILE)
    order = ["length", "label", "cell", "vec_id"]
    rows = whole.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(
        "length", "label", "v", "vec_id", "n", key().alias("key"), F.monotonically_increasing_id().alias("cls"))
    return stored(intervals(rows)), axes


def links(classes: DataFrame, size: int, axes: dict[int, np.ndarray], least: float, reach: float) -> DataFrame:
    """What ``compared`` finds, with AT_ONCE bytes of the blocks broadcast in each round. Blocks are chosen by
    a hash, so that every round has work for all tasks."""
    rounds = size // AT_ONCE + 1
    slim = classes.select("length", "label", "block", "cls", "n", "v")

    def found() -> Iterator[DataFrame]:
        for k in range(rounds):
            out, sent = compared(slim, slim.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == k), axes, least, reach)
            yield out
            sent.destroy()

    return gathered(found())


def numbers(usable: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """vec_id and cls of every row. Vectors meet on a hash; only if two of a label share one, by themselves."""
    for on in (["label", "key"], ["label", "key", "v"]):
        rows = stored(usable.select("vec_id", "label", key().alias("key"), "v").join(
            classes.select("label", "key", "v", "cls").select(*on, "cls").hint("merge"), on).select("vec_id", "cls"))
        if rows.count() == n:
            break
    return rows
