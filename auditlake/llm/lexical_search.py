"""Operator 11: ranked lexical search by dense blocked matrix products.

Items (the queries) are cut into blocks of bounded size. A block's terms make a compact
vocabulary; documents, in tiles, become dense rows of term impacts over a tile of that
vocabulary, and one float64 product with the items' term weights gives all partial scores of the
tile. Impacts and weights are integers and a vocabulary tile is so narrow that no partial sum
reaches 2^53, so the products are exact; the tiles are added up as 64-bit integers. A task keeps
the best documents of each item with ties settled by id, and Spark merges the tasks' lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TERM, TERM_BYTES, lower_ascii, running_sum, slices, stored

BLOCK = 1 << 14  # terms of a block of items; an item counts as LEAST terms at least
LEAST = 64  # so a block has at most 256 items
TILE = 2048  # vocabulary columns multiplied at once
ROWS = 512  # documents multiplied at once
IMPACT = 10**6  # no impact is above it
SPLITS = 64  # groups in which the tasks' lists are merged first
COUNTED, TERMS = -1, -2  # rows of the statistics beside those of the terms


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def statistics(docs: DataFrame, vocabulary: list[bytes], text: str) -> dict[int, int]:
    """By position in the vocabulary, the documents that hold a term; at ``COUNTED`` the documents
    with a term, at ``TERMS`` all their terms. A task sends one row for each."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})  # BLOCK bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        held, counted, total = np.zeros(len(at) + 1, np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, 0, 1 << 22):
                for t in part.column(0).to_pylist():
                    found = terms(t)
                    counted += bool(found)
                    total += len(found)
                    held[list({at.get(x, -1) for x in found})] += 1
        hit = np.nonzero(held[:-1])[0]
        yield pa.RecordBatch.from_arrays([pa.array([COUNTED, TERMS, *hit.tolist()], pa.int32()),
                                          pa.array([counted, total, *held[hit].tolist()], pa.int64())], ["term", "n"])

    slim = docs.select(docs[text].cast("string").alias("text"))
    found = slim.mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in found.collect()}


class Block:
    """What a task needs to score documents for a block of items."""

    def __init__(self, items: list[list[bytes]], vocabulary: list[bytes], stats: dict[int, int]):
        self.docs, self.total = stats.get(COUNTED, 0), stats.get(TERMS, 0)
        self.at = {t: i for i, t in enumerate(vocabulary)}
        self.weight = np.array([math.floor(1000 * math.log((2 * self.docs + 2) / (2 * stats.get(i, 0) + 1)))
                                for i in range(len(vocabulary))], np.float64)
        if vocabulary and TILE * self.weight.max() * IMPACT >= 1 << 53:
            raise ValueError("partial sums could reach 2^53")
        self.items = len(items)
        self.of_item = np.repeat(np.arange(len(items)), [len(x) for x in items])
        self.of_term = np.array([self.at[t] for x in items for t in x], np.int64)

    def weights(self, tile: int) -> np.ndarray:
        """Vocabulary tile x items."""
        inside = self.of_term // TILE == tile
        table = np.zeros((TILE, self.items))
        table[self.of_term[inside] % TILE, self.of_item[inside]] = self.weight[self.of_term[inside]]
        return table

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Documents x items."""
        rows, columns, impacts = [], [], []
        for row, t in enumerate(texts):
            found = terms(t)
            ids = np.fromiter(map(self.at.get, found, repeat(-1)), np.int64, len(found))
            ids = np.sort(ids[ids >= 0])
            if not len(ids):
                continue
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            tf = np.diff(np.append(first, len(ids)))
            m = 50 + 50 * len(found) * self.docs // self.total
            rows.append(np.full(len(first), row))
            columns.append(ids[first])
            impacts.append(10**9 * tf // (1000 * tf + 20 * m))
        total = np.zeros((len(texts), self.items), np.int64)
        if not rows:
            return total
        rows, columns, impacts = map(np.concatenate, (rows, columns, impacts))
        for tile in np.unique(columns // TILE):
            inside = columns // TILE == tile
            dense = np.zeros((len(texts), TILE))
            dense[rows[inside], columns[inside] % TILE] = impacts[inside]
            total += (dense @ self.weights(tile)).astype(np.int64)
        return total


class Best:
    """The k best documents of each item so far; equal scores by id."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.kept = k, np.ones(items, np.int64), None

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        least = self.least
        if len(scores) > self.k:
            least = np.maximum(least, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        row, item = np.nonzero(scores >= least)
        if not len(row):
            return
        more = pa.table({"item": pa.array(item, pa.int32()), "score": pa.array(scores[row, item]), "id": ids.take(pa.array(row))})
        both = (more if self.kept is None else pa.concat_tables([self.kept, more])).sort_by(
            [("item", "ascending"), ("score", "descending"), ("id", "ascending")])
        item = both["item"].to_numpy()
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.least[item[last]] = both["score"].to_numpy()[last]
        self.kept = both.filter(pa.array(place < self.k)).combine_chunks()


def blocks(items: DataFrame, item: str, text: str) -> DataFrame:
    """Items with a term: ``block, _item, _terms`` (each once)."""
    found = F.array_distinct(F.regexp_extract_all(lower_ascii(items[text].cast("string")), F.lit(f"({TERM})")))
    slim = items.select(items[item].alias("_item"), found.alias("_terms")).where(F.size("_terms") > 0).select(
        "*", F.xxhash64("_terms").alias("_turn"), F.greatest(F.size("_terms"), F.lit(LEAST)).cast("bigint").alias("_size"))
    upto = running_sum(slim, [], ["_item", "_turn"], "_size", "_upto")
    return stored(upto.select(F.expr(f"(_upto - 1) div {BLOCK}").alias("block"), "_item", "_terms"))


def search(docs: DataFrame, items: DataFrame, k: int = 50, id: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents of each item with a
    score above 0; all documents are scored for all items.

    An item or document that is null, empty or has no term finds nothing and is not found. Items
    that repeat are items of their own; equal scores rank by id, null ids last, and rows that share an
    id each take a rank. Empty tables give no rows. Other columns do not matter. A very long item
    makes a block of its own; a very long document is one row of its tile. Documents are read twice
    for each block of items; the driver holds the terms of one block."""
    spark = docs.sparkSession
    asked = blocks(items, item, item_text)
    n = asked.agg(F.max("block")).first()[0]
    kind, of_item = dict(docs.dtypes)[id], dict(items.dtypes)[item]
    ranked = [_search_block(docs, asked.where(F.col("block") == b).collect(), k, id, text, of_item)
              for b in range(0 if n is None else n + 1)]
    if not ranked:
        return spark.createDataFrame([], f"item_id {of_item}, rank int, doc_id {kind}, score bigint")
    whole = ranked[0]
    for more in ranked[1:]:
        whole = whole.unionByName(more)
    return whole


def _search_block(docs: DataFrame, rows: list, k: int, id: str, text: str, of_item: str) -> DataFrame:
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id]
    items = [[t.encode() for t in r["_terms"]] for r in rows]
    vocabulary = sorted({t for x in items for t in x})
    block = Block(items, vocabulary, statistics(docs, vocabulary, text))
    shared = spark.sparkContext.broadcast(block)  # BLOCK bounds it
    slim = docs.select(docs[id].alias("id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        best = Best(b.items, k)
        for batch in batches:
            for part in slices(batch, 1, 1 << 22):
                for at in range(0, part.num_rows, ROWS):
                    tile = part.slice(at, ROWS)
                    best.add(tile.column(0), b.scores(tile.column(1).to_pylist()))
        if best.kept is not None:
            yield from best.kept.to_batches()

    found = slim.mapInArrow(run, f"item int, score bigint, id {kind}")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    parts = found.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(SPLITS)))
    parts = parts.withColumn("_n", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order))).where(F.col("_n") <= k)
    top = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["_item"]) for i, r in enumerate(rows)], f"item int, item_id {of_item}")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
