"""From raw documents to token ids: STAGES, each written and read again before the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import line_dedup, minhash, mixing, quality, sentencepiece_bpe
from auditlake.llm.common import WRITTEN, forget, load, shared_folder, stored


def counted(docs: DataFrame) -> DataFrame:
    """n_chars after the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, written once so that it stays theirs, and its name."""
    name = "_row"
    while name in map(str.lower, docs.columns):
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id())), name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; from the others the lines above the host's limit."""
    return counted(quality.clean(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand elsewhere before go from the text."""
    return counted(line_dedup.dedup(docs).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest id, null last. Rows are told apart by
    number, so of equal rows, with or without an id, one stays too."""
    rows, row = numbered(docs)
    found = minhash.near_duplicates(rows, id=row).select(F.col("doc_id").alias("_n"), "component_id")
    named = rows.select(row, F.col("doc_id").isNull().alias("_none"), "doc_id").join(found.hint("merge"), F.col(row) == F.col("_n"))
    kept = named.groupBy("component_id").agg(F.min(F.struct("_none", "doc_id", row)).alias("_k")).select(F.col(f"_k.{row}").alias(row))
    return rows.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    rows, row = numbered(docs)
    taken = mixing.mix(rows, row=row).where("copies > 0").select(F.col("row").alias("_taken"), F.col("copies").alias("_copies"))
    joined = rows.join(taken.hint("merge"), F.col(row) == F.col("_taken"))
    return joined.withColumn("_turn", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document."""
    tokens = sentencepiece_bpe.encode(docs.select("doc_id", "lang", "source", "text"),
                                      public_tokenizers.path("piece_bpe_32k.model"), decoded=False)
    return tokens.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality_rules), ("line_dedup", repeated_lines), ("minhash_near_dedup", near_duplicates),
          ("mixing", mixture), ("sentencepiece", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        made: list[str] = []  # the stage's intermediate tables go once its result is written
        token = WRITTEN.set(made)
        try:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        finally:
            WRITTEN.reset(token)
        forget(spark, made)
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
