"""Operator 12: toxicity by logistic regression, learned with FTRL-proximal.

Features are hashed words, word pairs and pairs with one word between. Each coordinate has its
own learning rate, and an L1 penalty keeps a weight at zero until its gradients agree, so the
learned weights are few and go to all tasks. Features that few labelled texts hold are left out,
as they would learn single texts by heart. Shards of labelled rows learn side by side from
common weights; after each round the change of a coordinate is the mean over the shards that
touched it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TERM_BYTES, mix, slices, stored, word_hashes

BITS = 20  # 2^BITS coordinates bound the weights
SAMPLE = 30_000  # labelled rows to learn from, about; fewer are all taken
SHARD = 15_000  # rows of a shard
ROUNDS = 10
SEEN, SHARE = 3, 2_000  # a feature must stand in so many texts of the sample, and in one of SHARE
ALPHA, BETA, L1, L2 = 3.0, 1.0, 8.0, 0.1
SLICE = 1 << 20


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a column, in order; a null text has none."""
    return word_hashes(texts, TERM_BYTES)


def features(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and row of each word, each pair of neighbours and each pair with a word between."""
    shift = np.uint64(64 - BITS)
    found, of = [hashes >> shift], [rows]
    for gap, salt in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        same = rows[gap:] == rows[:-gap]
        pair = mix(hashes[:-gap] * np.uint64(salt) + hashes[gap:])
        found.append(pair[same] >> shift)
        of.append(rows[gap:][same])
    return np.concatenate(found).astype(np.int64), np.concatenate(of)


@dataclass
class Model:
    """The coordinates whose weight is not zero."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of each text of a column; a feature counts once a text."""
        table = np.zeros(1 << BITS, np.float32)
        table[self.at] = self.weight
        margin = np.full(len(texts), self.bias)
        found, of = features(*words(texts))
        hit = table[found] != 0
        once = np.unique((of[hit] << BITS) | found[hit])
        np.add.at(margin, once >> BITS, table[once & ((1 << BITS) - 1)])
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _learn(z: np.ndarray, n: np.ndarray, at: np.ndarray, label: float) -> None:
    """One row. The last coordinate is the bias, which has no penalty."""
    zs, ns = z[at], n[at]
    w = weights(zs, ns)
    w[-1] = -zs[-1] / ((BETA + math.sqrt(ns[-1])) / ALPHA)
    g = 1 / (1 + math.exp(-max(-500.0, min(500.0, float(w.sum()))))) - label
    z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
    n[at] = ns + g * g


def sample(labels: DataFrame, id: str, label: str, rows: int = SAMPLE) -> DataFrame:
    """``id, label`` of about ``rows`` labelled ids, chosen by a hash of the id; the labels of an id
    that repeats become their greatest."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("_id")).agg(
        F.max(F.col(label)).cast("double").alias("_label"))
    share = min(1.0, rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else known


def _once(texts: pa.Array, usual: np.ndarray) -> np.ndarray:
    """Sorted (row << BITS) + coordinate of the features of a column, each once a row."""
    found, of = features(*words(texts))
    inside = usual[found]
    return np.unique((of[inside] << BITS) | found[inside])


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a partition hold each coordinate."""
    total, all = np.zeros(1 << BITS, np.int64), np.ones(1 << BITS, bool)
    for batch in batches:
        for part in slices(batch, 0, SLICE):
            total += np.bincount(_once(part.column(0), all) & ((1 << BITS) - 1), minlength=1 << BITS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = SAMPLE) -> Model:
    """Learn from the documents that ``labels`` has a 0 or 1 for, in the order of a hash.

    Only about ``rows`` labels are used, so their ids are small enough for a broadcast. Null ids,
    labels and texts teach nothing; no labels give a model that says 0.5."""
    spark = docs.sparkSession
    chosen = sample(labels, id, label, rows)
    taught = docs.where(docs[text].isNotNull()).select(docs[id].alias("_id"), docs[text].cast("string").alias("_text")).join(
        F.broadcast(chosen), "_id").select("_id", "_text", "_label")

    labelled = chosen.count()
    shards = max(1, math.ceil(labelled / SHARD))
    held = taught.select("_text").mapInArrow(_holders, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    # at most one row for each coordinate; from here on a feature is its place among these
    usual = np.sort(held.where(F.col("n") >= max(SEEN, labelled // SHARE)).select("at").toArrow()["at"].to_numpy())
    kept = spark.sparkContext.broadcast(usual.astype(np.int32))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[kept.value] = np.arange(len(kept.value))
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                once = _once(part.column(0), place >= 0)
                ends = np.searchsorted(once, np.arange(part.num_rows + 1) << BITS)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[once & ((1 << BITS) - 1)]))
                yield pa.RecordBatch.from_arrays([lists, *part.columns[1:]], ["at", "label", "turn"])

    turn = taught.select("_text", F.col("_label").alias("label"), F.xxhash64(F.lit("turn"), "_id", "_text", "_label").alias("turn"))
    dealt = stored(turn.mapInArrow(extract, "at array<int>, label double, turn bigint").repartition(shards, "turn")
                   .sortWithinPartitions("turn").select("at", "label"))
    size = len(usual) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((z, n))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (old_z, old_n), z, n = shared.value, shared.value[0].copy(), shared.value[1].copy()
            for batch in batches:
                for where, label in zip(batch.column(0), batch.column(1).to_pylist()):
                    _learn(z, n, np.append(where.values.to_numpy(), size - 1), label)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.float32())) for v in (
                (z - old_z).astype(np.float32), (n - old_n).astype(np.float32))], ["z", "n"])

        # one row for each shard, and SAMPLE / SHARD bounds these
        moved, touched = [np.zeros(size), np.zeros(size)], np.zeros(size)
        for zs, ns in zip(*(c.combine_chunks() for c in dealt.mapInArrow(learn, "z array<float>, n array<float>").toArrow().columns)):
            zs, ns = zs.values.to_numpy().astype(np.float64), ns.values.to_numpy().astype(np.float64)
            touched += ns > 0
            moved[0] += zs
            moved[1] += ns
        z += moved[0] / np.maximum(touched, 1)
        n += moved[1] / np.maximum(touched, 1)
        shared.destroy()
    kept.destroy()
    w = weights(z, n)
    at = np.flatnonzero(w[:-1])
    return Model(usual[at].astype(np.int32), w[at].astype(np.float32), float(-z[-1] / ((BETA + math.sqrt(n[-1])) / ALPHA)))


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", limit: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from ``limit`` on) of every row, from its whole text alone.

    A null or empty text and one without a word get the model's bias. Repeated rows repeat; other
    columns do not matter. Texts are taken in slices of about a megabyte; a longer one is a slice."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BITS bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                p = m.scores(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= limit).astype(np.int32))],
                                                 ["doc_id", "score", "predicted"])

    slim = docs.select(docs[id].alias("doc_id"), docs[text].cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, score double, predicted int")
