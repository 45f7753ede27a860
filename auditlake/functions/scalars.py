"""Scalar lookups on finding columns: severity, confidence, weakness and merge keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import CWE_ALIASES, CWE_NAMES, CWE_URL_PREFIX, DETECTOR_RANK, REPORT_RANK, SEVERITY_RANK


def lookup(key: Column, mapping: dict, default: Column) -> Column:
    """A small fixed mapping as a chain of comparisons (stays in generated code)."""
    pairs = iter(mapping.items())
    k, v = next(pairs)
    out = F.when(key == F.lit(k), F.lit(v))
    for k, v in pairs:
        out = out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(default)


def severity_rank(severity: Column) -> Column:
    """info 0 .. critical 4; an unknown name ranks 0."""
    return lookup(severity, SEVERITY_RANK, F.lit(0))


def report_rank(severity: Column) -> Column:
    """critical 0 .. info 4, unknown 9: the order of a report."""
    return lookup(severity, REPORT_RANK, F.lit(9))


def confidence_percent(confidence: Column) -> Column:
    return F.floor(F.coalesce(confidence, F.lit(0.0)) * 100 + F.lit(0.5)).cast("bigint")


def confidence_band(confidence: Column) -> Column:
    p = confidence_percent(confidence)
    return (F.when(p >= 80, "high").when(p >= 60, "med-high").when(p >= 40, "med").otherwise("low"))


def cwe_url(cwe_id: Column) -> Column:
    return F.concat(F.lit(CWE_URL_PREFIX), F.replace(cwe_id, F.lit("CWE-"), F.lit("")), F.lit(".html"))


def cwe_name(cwe_id: Column) -> Column:
    return lookup(cwe_id, CWE_NAMES, cwe_id)


def canonical_cwe(cwe_id: Column) -> Column:
    return lookup(cwe_id, CWE_ALIASES, cwe_id)


def function_key(function_name: Column, vuln_type: Column) -> Column:
    return F.lower(F.when(F.coalesce(function_name, F.lit("")) != "", function_name)
                   .otherwise(F.regexp_extract(vuln_type, r"(?U)(\w+)", 1)))


def detector_rank(detector: Column) -> Column:
    """Trust in a detector; a merged name such as "ast+regex" ranks 0."""
    return lookup(detector, DETECTOR_RANK, F.lit(0))
