"""Sinks: JSON findings, report tables and fixed files. None gathers data in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import materialized, sized_join

FINDING_FIELDS = [
    "file_path", "line", "column", "vuln_type", "rule_id", "cwe_id", "severity", "confidence",
    "description", "recommendation", "snippet", "detector", "function_name", "llm_confirmed",
    "llm_confidence", "llm_explanation", "llm_fix",
]
DEFAULTS = {"column": 0, "snippet": "", "llm_confirmed": None, "llm_confidence": None,
            "llm_explanation": "", "llm_fix": ""}
NULL_TYPES = {"llm_confirmed": "boolean", "llm_confidence": "double"}


def full_findings(findings: DataFrame) -> DataFrame:
    """All fields of the finding record, in order; missing ones get their default."""
    have = set(findings.columns)
    return findings.select(*[
        F.col(c) if c in have else F.lit(DEFAULTS[c]).cast(NULL_TYPES[c]).alias(c)
        if c in NULL_TYPES else F.lit(DEFAULTS[c]).alias(c) for c in FINDING_FIELDS])


def finding_json(findings: DataFrame) -> DataFrame:
    """file_path and one JSON document per finding (nulls written out)."""
    full = full_findings(findings)
    return full.select("file_path", F.to_json(
        F.struct(*FINDING_FIELDS), {"ignoreNullFields": "false"}).alias("json"))


def write_report(findings: DataFrame, summary: DataFrame, errors: DataFrame, folder: str) -> None:
    """``summary``, ``findings`` and ``errors`` as JSON lines in sub-folders."""
    summary.write.mode("overwrite").json(f"{folder}/summary")
    full_findings(findings).write.mode("overwrite").option("ignoreNullFields", "false").json(
        f"{folder}/findings")
    errors.write.mode("overwrite").json(f"{folder}/errors")


def with_out_path(fixed: DataFrame, output_dir: str) -> DataFrame:
    """Where each fixed file goes: its base name, or parent/base name for all files as soon
    as two files share a base name. The fixed files are written once; names and texts are both
    read from there."""
    kept = materialized(fixed)
    name = text.basename(F.col("file_path"))
    clash = (kept.select(name.alias("_name")).groupBy("_name").count().where("count > 1")
             .agg((F.count("*") > 0).alias("clash")).scalar())
    parent = F.element_at(F.split("file_path", "/", -1), -2)
    return kept.withColumn("out_path", F.concat(
        F.lit(output_dir.rstrip("/") + "/"), F.when(clash, F.concat(parent, F.lit("/"))).otherwise(""), name))


def write_fixed(fixed: DataFrame, output_dir: str) -> None:
    with_out_path(fixed.select("file_path", "fixed_code"), output_dir).select("file_path", "out_path", "fixed_code").write.mode(
        "overwrite").parquet(output_dir)


def publish(fixed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Replacement set: original path, backup path and new text, or an error row.

    Fixed files that come from their own rows have the original beside them (``code``). For
    others ``files`` tells which originals there are."""
    if files is None:
        joined = fixed.select("file_path", "fixed_code", F.col("code").isNotNull().alias("_found"))
    else:
        originals = files.select("file_path").distinct().withColumn("_found", F.lit(True))
        joined = sized_join(fixed.select("file_path", "fixed_code"), originals, "file_path", "left")
    found: Column = F.coalesce("_found", F.lit(False))
    return joined.select(
        text.basename(F.col("file_path")).alias("filename"),
        F.when(found, F.col("file_path")).alias("original_path"),
        F.when(found, F.concat("file_path", F.lit(".bak"))).alias("backup_path"),
        F.when(found, F.col("fixed_code")).alias("code"),
        F.when(found, "applied").otherwise("error").alias("status"),
        F.when(~found, "Original file not found").alias("error"))
