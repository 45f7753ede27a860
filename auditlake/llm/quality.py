"""Operator 5: quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; for each host the distinct documents that hold a line are
counted. Lines above the host's limit are boilerplate and go; a document that loses too much
of its words that way is depleted and rejected. Copies of a text count as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, let, lower_ascii, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 3


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def normalised(line: Column) -> Column:
    """A-Z lower-cased, words joined by one blank."""
    return F.trim(F.regexp_replace(lower_ascii(line), r"[\x20\x09-\x0D]+", " "))


def with_word(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.length(F.trim(F.translate(x, SPACES, " " * len(SPACES)))) > 0)


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more. Windows are sorted by a hash and
    their words, so equal ones are neighbours; the places found are then swept once."""
    window = lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]).alias("h"),
                                *[F.get(words, i + j).alias(f"w{j}") for j in range(WINDOW)], i.alias("i"))
    same = lambda a, b: (a["h"] == b["h"]) & (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"])
    twice = lambda s: F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False))
                               | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)))
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), window)
    places = F.sort_array(F.transform(let(F.sort_array(windows), twice), lambda x: x["i"]))
    swept = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, p: F.struct(
        (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return F.when(F.size(words) >= WINDOW, swept).otherwise(0)


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, key (hash of the text), the base figures, base_failed, and lines: hash and
    words of each distinct normalised line. A null text has no words and no lines."""
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    base = docs.select(docs[id].alias("doc_id"), docs[host].alias("host"), t.alias("text"))
    words = let(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n"), repeated_words(w).cast("bigint").alias("repeated")))
    lines = let(with_word(F.split("text", "\n")), lambda x: F.struct(
        (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"),
        F.transform(x, lambda y: F.struct(F.xxhash64(normalised(y)).alias("line"),
                                          F.regexp_count(y, F.lit(WORD)).cast("bigint").alias("words"))).alias("lines")))
    figures = base.select(
        "doc_id", "host", F.xxhash64("text").alias("key"), words.alias("w"), lines.alias("l"),
        F.length(without(F.col("text"), SPACES)).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("bigint").alias("n_symbols"))
    n, repeated = F.col("w.n"), F.col("w.repeated")
    return figures.select("doc_id", "host", "key", n.alias("n_words"), "word_chars", "n_symbols",
                          F.col("l.dup").alias("n_dup_lines"), repeated.alias("n_repeat_words"),
                          ((n < 50) | (100 * repeated > 50 * n)).alias("base_failed"), F.col("l.lines").alias("lines"))


SURE = 11.0  # square of the normal quantile of a one in a thousand chance, rounded up


def boilerplate(found: DataFrame, percent: int, least: int) -> DataFrame:
    """host, line of the lines whose share of the host's documents is above ``percent`` for certain:
    the share's lower confidence bound (Wilson's) is above it, alike at every size of host. A line
    in fewer than ``least`` documents says nothing. Null is a host like others."""
    per_host = found.groupBy("host").agg(F.countDistinct("key").alias("documents"))
    rows = found.select("host", "key", F.explode("lines").alias("x")).select("host", "key", F.col("x.line").alias("line"))
    held = rows.groupBy("host", "line").agg(F.countDistinct("key").alias("n")).where(F.col("n") >= least)
    per_host = per_host.withColumnRenamed("host", "h")
    above = 100.0 * F.col("n") - percent * F.col("documents")
    return held.join(per_host, F.col("host").eqNullSafe(F.col("h"))).where(
        (above > 0) & (above * above > SURE * percent * (100 - percent) * F.col("documents"))).select("host", "line")


def judge(docs: DataFrame, percent: int = 2, least: int = 3, depleted: int = 50, id: str = "doc_id",
          text: str = "text", host: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, host, key, the base figures, base_failed, removed
    (hashes of the lines that go), removed_words and kept.

    A document is rejected if the base rules fail or if more than ``depleted`` percent of its
    words lie in boilerplate lines. Rows with the same id, host and text are one document.
    A text without lines has nothing to remove. An empty table gives no rows."""
    found = stored(measures(docs, id, text, host))
    bad = boilerplate(found, percent, least).select(F.col("host").alias("h"), F.col("line").alias("bad"))
    rows = found.select("doc_id", "host", "key", F.explode("lines").alias("x")).select(
        "doc_id", "host", "key", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    rows = rows.groupBy("doc_id", "host", "key", "line").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    hit = rows.join(bad, (F.col("line") == F.col("bad")) & F.col("host").eqNullSafe(F.col("h")))
    copies = found.groupBy(F.col("doc_id").alias("d"), F.col("host").alias("h"), F.col("key").alias("k")).agg(F.count("*").alias("copies"))
    lost = hit.groupBy("doc_id", "host", "key").agg(F.sum("words").alias("lost"), F.collect_set("line").alias("removed"))
    lost = lost.join(copies, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("host").eqNullSafe(F.col("h")) & (F.col("key") == F.col("k")))
    lost = lost.select("d", "h", "k", (F.col("lost") / F.col("copies")).cast("bigint").alias("removed_words"), "removed")
    all_ = found.drop("lines").join(lost, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("host").eqNullSafe(F.col("h"))
                                    & (F.col("key") == F.col("k")), "left").drop("d", "h", "k")
    lost_words = F.coalesce("removed_words", F.lit(0)).cast("bigint")
    return all_.withColumn("removed_words", lost_words).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("removed_words") <= depleted * F.col("n_words")))


def clean(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """``docs`` without rejected documents and, in the others, without boilerplate lines."""
    verdict = judge(docs, id=id, text=text, host=host, **limits).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("key").alias("_key"), F.col("removed").alias("_removed"))
    verdict = verdict.dropDuplicates(["_id", "_host", "_key"])
    key = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    joined = docs.join(verdict, F.col(id).eqNullSafe(F.col("_id")) & F.col(host).eqNullSafe(F.col("_host")) & (key == F.col("_key")))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("_removed", F.xxhash64(normalised(x)))), "\n")
    kept = F.when(F.col("_removed").isNull(), F.col(text)).otherwise(left)
    return joined.withColumn(text, kept).select(*docs.columns)
