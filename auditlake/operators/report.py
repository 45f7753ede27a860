"""Report rows and details as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..session import numbered
from .merge import report_keys

REPORT_COLUMNS = ["number", "severity", "rule_id", "cwe_id", "file_name", "line", "vuln_type",
                  "recommendation", "detector"]


def enumerate_findings(findings: DataFrame) -> DataFrame:
    return numbered(findings, report_keys(), "number")


def rows(findings: DataFrame) -> DataFrame:
    """Numbered report rows with HTML-escaped texts."""
    return enumerate_findings(findings).select(
        "number", F.upper("severity").alias("severity"), "rule_id", "cwe_id",
        text.basename(F.col("file_path")).alias("file_name"), F.col("line").cast("bigint").alias("line"),
        text.escape_html(F.col("vuln_type")).alias("vuln_type"),
        text.escape_html(F.col("recommendation")).alias("recommendation"), "detector")


def details(findings: DataFrame) -> DataFrame:
    """The long block of each finding."""
    explanation = F.col("llm_explanation") if "llm_explanation" in findings.columns else F.lit("")
    block = F.concat(
        F.col("vuln_type"), F.lit("\nFile: "), F.col("file_path"), F.lit(":"), F.col("line").cast("string"),
        F.lit("\nCWE:  "), F.col("cwe_id"), F.lit("\nDesc: "), F.col("description"),
        F.lit("\nFix:  "), F.col("recommendation"), F.lit("\n"),
        F.when(F.coalesce(explanation, F.lit("")) != "", F.concat(F.lit("\nLLM:  "), explanation)).otherwise(""))
    return enumerate_findings(findings).select(
        "number", F.concat(F.lit("#"), F.col("number").cast("string"), F.lit(" ["), F.upper("severity"),
                           F.lit("]")).alias("title"), block.alias("block"))


def search_rows(report: DataFrame, query: str = "", severity: str = "all") -> DataFrame:
    """Substring anywhere in the row's text, the cells set side by side."""
    out = report
    if severity != "all":
        out = out.where(F.lower("severity") == severity)
    if query:
        cells = F.concat(*[F.lower(F.col(c).cast("string")) for c in REPORT_COLUMNS])
        out = out.where(F.contains(cells, F.lit(query.lower())))
    return out


def list_view(findings: DataFrame) -> DataFrame:
    """Columns of the findings list: base name, confidence percent and band, short text."""
    return findings.select(
        "file_path", text.basename(F.col("file_path")).alias("file_name"), "line", "rule_id",
        scalars.confidence_percent(F.col("confidence")).alias("confidence_pct"),
        scalars.confidence_band(F.col("confidence")).alias("band"),
        text.truncate(F.col("description"), 80).alias("short_description"))
