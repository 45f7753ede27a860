"""Operator 10: near-duplicate documents by min-max hashing.

Every permutation of a document's shingles gives two signature values, the least and the
greatest, so half the hash evaluations fill a signature. Bands of it put documents into
buckets. Documents with equal shingle sets are one class and only its smallest id goes on. In
each bucket members are first compared with one centre. Members that then still lie in
different components are put into blocks, and two blocks that share a bucket are compared as
matrices inside a task, so every pair that shares a bucket is connected by links or was
compared on the full shingle sets, and no pairs are written out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, find, running_sum, slices, stored, word_hashes

# A-Z to lower case, white space to blanks
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = 2048  # shingles hashed or compared at once
BLOCK = 128  # documents in a block; one counts once more for every LARGE shingles
LARGE = 4096
SLICE = 1 << 20  # bytes of text worked on at once


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text of a column the sorted 64-bit hashes of its distinct shingles; A-Z are
    lower-cased and words end at ASCII white space. A text with fewer words is one shingle; without
    words there is none."""
    hashes, rows = word_hashes(texts, WORD_BYTES)
    ends = np.searchsorted(rows, np.arange(len(texts) + 1))
    return [_shingles(hashes[a:b], size) for a, b in zip(ends[:-1], ends[1:])]


def shingles(text: str | None, size: int) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.large_string()), size)[0]


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    if not len(h):
        return np.empty(0, np.uint64)
    size = min(size, len(h))
    n = len(h) - size + 1
    s = np.full(n, size, np.uint64)
    for j in range(size):
        s = mixed((s ^ h[j:j + n]) * MIX + np.uint64(j))
    return np.unique(s)


def signature(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation, side by side."""
    least = np.full(len(factors), ~np.uint64(0), np.uint64)
    most = np.zeros(len(factors), np.uint64)
    for at in range(0, len(s), STEP):
        v = s[at:at + STEP, None] * factors[None, :]
        least = np.minimum(least, v.min(0))
        most = np.maximum(most, v.max(0))
    return np.stack([least, most], 1).ravel()


def sketches(docs: DataFrame, id: str, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (equal for equal sets, null for none) and bands of each row."""
    factors = np.random.default_rng(2718281828).integers(0, 2**64, bands * rows // 2, np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, 1, SLICE)):
            sizes, digests, keys = [], [], []
            for s in shingle_sets(part.column(1), shingle):
                sizes.append(len(s))
                if len(s):
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    values = signature(s, factors).reshape(bands, rows)
                    key = np.arange(bands, dtype=np.uint64)
                    for j in range(rows):
                        key = mixed((key ^ values[:, j]) * MIX)
                    keys.append(key.view(np.int64))
                else:
                    digests.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    slim = docs.select(docs[id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (q for batch in batches for p in slices(batch, 2, SLICE) for q in slices(p, 3, 4 * SLICE)):
            # pairs come sorted by v, so each of its texts is cut once a slice
            v = part.column(1).to_numpy()
            fresh = np.append(True, v[1:] != v[:-1])
            others = shingle_sets(part.column(3).filter(pa.array(fresh)), shingle)
            keep = []
            for a, k in zip(shingle_sets(part.column(2), shingle), np.cumsum(fresh) - 1):
                b = others[k]
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u"))
    two = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v"))
    return (pairs.join(one.hint("merge"), "u").join(two.hint("merge"), "v").select("u", "v", "text_u", "text_v")
            .mapInArrow(run, "u bigint, v bigint"))


def similar(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of the left and the right are similar enough, as a matrix."""
    sets = left + right
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    order = order[n[column[order]] > 1]
    row, column = row[order], column[order]
    step = np.cumsum(np.diff(column, prepend=column[:1]) > 0) if len(column) else column
    both = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(step[-1]) + 1 if len(step) else 0, STEP):
        a, b = np.searchsorted(step, [lo, lo + STEP])
        m = np.zeros((len(sets), STEP), np.float32)
        m[row[a:b], step[a:b] - lo] = 1
        both += m[:len(left)] @ m[len(left):].T
    every = sizes[:len(left), None] + sizes[None, len(left):] - both
    return (100 * both >= percent * every) & (both > 0)


def joined(pairs: DataFrame, blocks: DataFrame, shingle: int, percent: int) -> DataFrame:
    """u, v: each document linked within a pair of blocks and the smallest one it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for c in (0, 1):
                    name = batch.column(c)[k].as_py()
                    if name not in known:
                        members = batch.column(2 + c)[k].as_py()
                        known = {x: y for x, y in known.items() if x == batch.column(0)[k].as_py()}
                        known[name] = ([m["doc_id"] for m in members], [m["part"] for m in members],
                                       shingle_sets(pa.array([m["text"] for m in members], pa.large_string()), shingle))
                    sides.append(known[name])
                (ids, parts, sets), (ids2, parts2, sets2) = sides
                parent: dict[int, int] = {}
                if len({*parts, *parts2}) > 1:
                    for i, j in zip(*np.nonzero(similar(sets, sets2, percent))):
                        if parts[i] != parts2[j]:
                            x, y = find(parent, ids[i]), find(parent, ids2[j])
                            parent[max(x, y)] = min(x, y)
                edges = [(x, find(parent, x)) for x in parent]
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["u", "v"])

    side = lambda x: blocks.select(F.col("block").alias(x), F.col("docs").alias(f"docs_{x}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return both.select("a", "b", "docs_a", "docs_b").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 24, rows: int = 4,
                    id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by
    links) and kept (whether it is that one).

    Linked are documents with ``100 * |A and B| >= percent * |A or B|`` over their word shingles.
    With the defaults a pair at 0.8 shares no bucket with probability 3e-6, at 0.85 with 2e-8.
    A document without words links with nothing. Rows that share an id are one node. A row
    without id links with nothing: component_id null, kept. Other columns are not read."""
    found = stored(sketches(docs, id, text, shingle, bands, rows))
    known = found.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("first"))
    classes = known.join(first.select(F.col("digest"), F.col("first").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    spots = classes.select("doc_id", F.explode("bands").alias("bucket"))
    full = spots.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"))
    members = stored(spots.join(full.where("a < b").select("bucket", "n"), "bucket"))
    # who shares buckets with most others makes the best centre
    weight = members.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    slim = docs.select(docs[id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    texts = stored(slim.join(weight.select("doc_id").hint("merge"), "doc_id", "left_semi"))
    weighed = members.select("bucket", "doc_id").join(weight, "doc_id")
    lead = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("less"))).alias("c"))
    pairs = members.join(lead.select("bucket", (-F.col("c.less")).alias("c")), "bucket").where("doc_id != c").select(
        F.least("doc_id", "c").alias("u"), F.greatest("doc_id", "c").alias("v")).distinct()
    links = stored(confirmed(pairs, texts, shingle, percent))
    nodes = stored(components(links))

    part = nodes.select(F.col("node").alias("doc_id"), F.col("component").alias("part"))
    at = members.select("bucket", "doc_id").join(part, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    open_ = at.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("doc_id").alias("least")).where("lo < hi")
    # in a bucket of two the centre was compared with the other one
    open_ = open_.join(full.where("n > 2").select("bucket"), "bucket", "left_semi")
    at = stored(at.join(open_.select("bucket", "least"), "bucket"))
    groups = components(at.select(F.col("doc_id").alias("u"), F.col("least").alias("v")))
    placed = at.select("doc_id", "part").distinct().join(groups.withColumnRenamed("node", "doc_id"), "doc_id")
    # a document of very many shingles fills a block by itself
    sizes = classes.groupBy("doc_id").agg((1 + F.expr(f"max(n_shingles) div {LARGE}")).alias("size"))
    weighed = placed.join(sizes, "doc_id")
    placed = running_sum(weighed, ["component"], ["doc_id"], "size", "at")
    block = F.xxhash64("component", F.floor((F.col("at") - 1) / BLOCK))
    placed = stored(placed.select("doc_id", "part", block.alias("block")))
    # a block holds BLOCK documents at most, and BLOCK * LARGE shingles unless it is one document
    blocks = stored(placed.join(texts.hint("merge"), "doc_id").groupBy("block").agg(
        F.collect_list(F.struct("doc_id", "part", "text")).alias("docs")))
    held = at.select("bucket", "doc_id").join(placed.select("doc_id", "block"), "doc_id").select("bucket", "block").distinct()
    pairs = held.withColumnRenamed("block", "a").join(held.withColumnRenamed("block", "b"), "bucket").where("a <= b").select("a", "b").distinct()
    links = joined(pairs, blocks, shingle, percent).unionByName(nodes.selectExpr("node AS u", "component AS v"))
    nodes = stored(components(links))

    label = first.join(nodes.withColumnRenamed("node", "first"), "first", "left").select(
        "digest", F.coalesce("component", "first").alias("component"))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(
        label, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))
