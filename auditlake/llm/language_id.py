"""Operator 8: language identification with error-correcting output codes.

Every language has a codeword. One binary classifier per bit, over hashed character n-grams,
tells the languages with a 1 there from those with a 0. Decoding adds up the loss of each
codeword, bits weighted by how well they separate, and takes the least; a small lead over the
second is flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BUCKETS = 1 << 13
MOST_LANGUAGES = 2000  # bounds what the driver gets: a count for each language and bucket
NOT_LETTERS = re.compile(r"[\W\d_]+")
STEEPNESS = 40.0  # of the score in the mean loss
UNCLEAR = 0.8  # scores below are flagged


def ngrams(text: str) -> np.ndarray:
    """How often each bucket is hit by the 1-, 2- and 3-grams of the letters."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = [c * np.uint64(0x9E3779B1), (c[:-1] * np.uint64(0x85EBCA77) + c[1:]) * np.uint64(0xC2B2AE3D),
         ((c[:-2] * np.uint64(0x27D4EB2F) + c[1:-1]) * np.uint64(0x165667B1) + c[2:]) * np.uint64(0x9E3779B1)]
    h = np.concatenate(h)
    return np.bincount(((h ^ (h >> np.uint64(15))) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)


def letters(text: str | None) -> str:
    """The lower-cased words of a text joined by blanks; empty if it has no letter."""
    words = NOT_LETTERS.sub(" ", text or "").lower()
    return words if any(map(str.isalpha, words)) else ""


def codewords(n: int) -> np.ndarray:
    """A row of bits for each language. Few languages get every way to split them in two, more get
    fixed pseudo-random columns that split them, as many as keep the rows far apart."""
    if n <= 6:
        columns = [[(k >> (n - 2 - i)) & 1 if i < n - 1 else 0 for i in range(n)] for k in range(1, 1 << max(0, n - 1))]
        return np.array(columns, np.int8).reshape(len(columns), n).T
    draw = np.random.default_rng(31415926)
    while True:
        code = draw.integers(0, 2, (n, 15 * int(np.ceil(np.log2(n)))), np.int8)
        if len(np.unique(code, axis=0)) == n and (code.min(0) < code.max(0)).all():
            return code


@dataclass
class Model:
    languages: list[str]
    signs: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # per bit

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language (``und`` without a letter or a learned language), score 0 to 1, ambiguous."""
        words = letters(text)
        if not words or not self.languages:
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        counts = ngrams(words)
        margins = counts @ self.weights / counts.sum()
        loss = np.logaddexp(0, -self.signs * margins) @ self.trust
        best = int(loss.argmin())
        share = 1 / np.exp((loss[best] - loss) * STEEPNESS).sum()
        return self.languages[best], float(share), bool(share < UNCLEAR)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows with a text and a language. Each partition counts n-grams by language;
    Spark adds the counts up. Rows without a letter add nothing; no rows give an empty model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words := letters(t):
                    total[name] = total.get(name, 0) + ngrams(words)
        for name, counts in total.items():
            hit = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit)), pa.array(hit.astype(np.int32)),
                                              pa.array(counts[hit].astype(np.int64))], ["lang", "bucket", "n"])

    known = docs.select(docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    counts = stored(known.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    names = sorted(r[0] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.zeros((len(names), BUCKETS))
    at = {n: i for i, n in enumerate(names)}
    for r in counts.collect():
        table[at[r.lang], r.bucket] = r.n
    return trained(names, table)


def trained(names: list[str], table: np.ndarray) -> Model:
    """Log odds of each bucket between the two sides of each bit, all languages counting alike."""
    if len(names) < 2:
        return Model(names, np.zeros((len(names), 0)), np.zeros((BUCKETS, 0)), np.zeros(0))
    share = (table + 0.5) / (table + 0.5).sum(1, keepdims=True)
    code = codewords(len(names))
    weights = np.stack([np.log(share[code[:, b] == 1].mean(0) / share[code[:, b] == 0].mean(0)) for b in range(code.shape[1])], 1)
    trust = np.abs(share @ weights).mean(0)
    return Model(names, code * 2.0 - 1, weights, trust / trust.sum())


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of each row, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages, bits and buckets bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    slim = docs.select(docs[id].alias("doc_id"), docs[text].cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, lang_pred string, score double, ambiguous boolean")
