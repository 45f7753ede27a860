"""Counts, rollups, searches, scoring and joins over files and findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, scalars, text
from ..functions.arrays import running, runs
from ..session import sized_join

SEVERITIES = ["critical", "high", "medium", "low", "info"]
SIGNIFICANT = ["critical", "high", "medium"]
SAFE_MARKS = ["safe", "_fixed", "_good"]


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.count("*").alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def summary(files: DataFrame, target: str, minimum: str = "low", seconds: float = 0.0) -> DataFrame:
    """One row, in one pass over files that carry all their findings: merging keeps every file that
    had any, and the threshold counts for the severities only."""
    least = dims.SEVERITY_RANK.get(minimum, 0)
    shown = [s for s in SEVERITIES if dims.SEVERITY_RANK[s] >= least]
    number = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s)).cast("bigint")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    counts = [F.count("*").alias("files_scanned"), F.count_if(F.size("findings") > 0).alias("files_with_issues")]
    kept = F.size(F.filter("findings", lambda f: scalars.severity_rank(f["severity"]) >= least)).cast("bigint")
    slim = files.select(kept.alias("total_findings"), "findings", *[(number(s) if s in shown else F.lit(0)).alias(s) for s in SEVERITIES])
    return slim.agg(*counts, *[total(c).alias(c) for c in ("total_findings", *SEVERITIES)]).select(
        F.lit(target).alias("target"), "files_scanned", "files_with_issues", "total_findings", *SEVERITIES,
        F.bround(F.lit(float(seconds)), 2).alias("duration_seconds"))


def severity_percent(findings: DataFrame) -> DataFrame:
    c = severity_counts(findings)
    total = F.greatest("total_findings", F.lit(1))
    return c.select(*[F.bround(F.col(s) / total * 100).cast("bigint").alias(f"{s}_pct")
                      for s in SEVERITIES[:4]])


def by_file(files: DataFrame) -> DataFrame:
    """The files with findings, each with its own in report order."""
    return files.select("file_path", "findings").where(F.size("findings") > 0)


def files_with_issues(files: DataFrame) -> DataFrame:
    """Number of files with at least one finding."""
    return files.agg(F.count_if(F.size("findings") > 0).alias("files_with_issues"))


def distinct_files(findings: DataFrame) -> DataFrame:
    return findings.select("file_path").distinct().orderBy("file_path")


def file_metadata(files: DataFrame) -> DataFrame:
    code = F.col("code")
    plain = files.select("file_path", "language", "code", text.strip_comments(code).alias("_plain"))
    return plain.select(
        F.col("file_path").alias("path"), text.total_lines(code).cast("bigint").alias("total_lines"),
        text.code_lines_of(F.col("_plain")).cast("bigint").alias("code_lines"), "language",
        text.includes(code).alias("includes"), text.functions_of(F.col("_plain")).alias("functions"))


def project_info(files: DataFrame) -> DataFrame:
    code = F.col("code")
    per = files.select("language", text.total_lines(code).alias("t"), text.code_lines(code).alias("c"))
    return per.agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("t"), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("total_code_lines"),
        F.create_map(F.lit("c"), F.count_if(F.col("language") == "c"),
                     F.lit("cpp"), F.count_if(F.col("language") == "cpp")).alias("languages"))


def top_files(files: DataFrame, n: int = 50) -> DataFrame:
    """The info table: metadata of the first ``n`` paths, with their base names."""
    first = files.orderBy("file_path").limit(n)
    m = file_metadata(first)
    return m.select(text.basename(F.col("path")).alias("file_name"), "path", "language", "total_lines",
                    "code_lines", F.size("functions").cast("bigint").alias("functions"),
                    F.size("includes").cast("bigint").alias("includes"))


def bench_file(files: DataFrame) -> DataFrame:
    """Score each file, which carries its findings, against the label that its name carries."""
    name = text.basename(F.col("file_path"))
    safe = F.lit(False)
    for mark in SAFE_MARKS:
        safe = safe | F.contains(F.lower(name), F.lit(mark))
    hit = F.exists("findings", lambda f: f["severity"].isin(SIGNIFICANT))
    return files.select(
        "file_path", name.alias("file_name"), F.size("findings").cast("bigint").alias("findings"),
        F.when(safe, "safe").otherwise("vuln").alias("expected"),
        F.when(safe & ~hit, "TN").when(safe, "FP").when(hit, "TP").otherwise("FN").alias("result"))


def bench_metrics(scores: DataFrame) -> DataFrame:
    n = scores.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("findings"), F.lit(0)).alias("total_findings"),
                   *[F.count_if(F.col("result") == r).alias(r.lower()) for r in ("TP", "TN", "FP", "FN")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.withColumns({
        "precision": p, "recall": r, "f1": ratio(2 * p * r, p + r),
        "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("total_files"))})


def rules_by_category(findings: DataFrame) -> DataFrame:
    """All rules per category and severity, with the raw hits they have in the data, from hits
    counted by rule (``n``)."""
    rules = dims.rule_dim(findings.sparkSession).groupBy("category", "severity").agg(
        F.count("*").alias("rules"))
    hits = findings.groupBy("category", "severity").agg(F.sum("n").alias("hits"))
    return rules.join(F.broadcast(hits), ["category", "severity"], "left").withColumn(
        "hits", F.coalesce("hits", F.lit(0)))


def rule_usage(raw: DataFrame) -> DataFrame:
    """The rule list, each with its number of raw hits."""
    hits = raw.groupBy("rule_id").agg(F.count("*").alias("hits"))  # at most one row per rule
    rules = dims.rule_dim(raw.sparkSession)
    return rules.join(F.broadcast(hits), rules["id"] == hits["rule_id"], "left").select(
        "id", "name", "pattern", "cwe_id", rules["severity"], "description", "recommendation",
        F.array_join("languages", ", ").alias("languages"), F.coalesce("hits", F.lit(0)).alias("hits"))


# ---------------------------------------------------------------- filters and searches

def _any_contains(columns: list[str], q: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q))
    return out


def significant(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity").isin(SIGNIFICANT))


def search_findings(findings: DataFrame, query: str = "", severity: str = "all",
                    file_path: str = "all") -> DataFrame:
    out = findings
    if severity != "all":
        out = out.where(F.lower("severity") == severity)
    if file_path != "all":
        out = out.where(F.col("file_path") == file_path)
    if query:
        out = out.where(_any_contains(
            ["description", "file_path", "cwe_id", "rule_id", "recommendation"], query.lower()))
    return out


def search_rules(rules: DataFrame, query: str = "") -> DataFrame:
    return rules.where(_any_contains(["name", "cwe_id", "description", "id"], query.lower())) if query else rules


# ---------------------------------------------------------------- joins

def attach(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files with the findings of a table, as ``merge.scan_files`` gives them: findings that went
    through other hands come back to their texts, so this is the one step that shuffles texts."""
    order = F.struct(scalars.report_rank(F.col("severity")).alias("rank"), "line", "seq",
                     *[c for c in findings.columns if c not in ("file_path", "rank", "line", "seq")])
    grouped = findings.groupBy("file_path").agg(F.sort_array(F.collect_list(order)).alias("findings"))
    joined = sized_join(files.drop("findings"), grouped, "file_path", "left")
    return joined.withColumn("findings", F.coalesce("findings", F.array().cast(grouped.schema["findings"].dataType)))


def held(files: DataFrame, findings: DataFrame | None) -> DataFrame:
    return files if findings is None else attach(files, findings)


def extended(f: Column, fields: Sequence[str], **more: Column) -> Column:
    """A finding of a file's row with further fields."""
    return F.struct(*[f[c].alias(c) for c in fields if c not in more], *[v.alias(k) for k, v in more.items()])


def fields_of(files: DataFrame, column: str = "findings") -> list[str]:
    return files.schema[column].dataType.elementType.fieldNames()


def with_snippet(files: DataFrame, window: int = 5) -> DataFrame:
    """The findings of files that carry them, each with the text around it; a file without a text
    gives empty ones."""
    fields = fields_of(files)
    lines = text.lines_of(F.coalesce("code", F.lit("")))
    snipped = text.let(lines, lambda ls: F.transform("findings", lambda f: extended(
        f, fields, snippet=text.window_of(ls, f["line"], window))))
    return files.select("file_path", F.inline(snipped)).drop("rank")


def fix_state(findings: DataFrame, fixed: DataFrame) -> DataFrame:
    """"Fixed" where the finding's file name has a fix, else "Rec." or a dash."""
    names = fixed.select(text.basename(F.col("file_path")).alias("_name")).distinct().withColumn(
        "_has_fix", F.lit(True))
    keyed = findings.withColumn("_name", text.basename(F.col("file_path")))
    return sized_join(keyed, names, "_name", "left").withColumn(
        "fix_state", F.when(F.col("_has_fix"), "Fixed")
        .when(F.coalesce("recommendation", F.lit("")) != "", "Rec.").otherwise("—")).drop("_name", "_has_fix")


def fix_original(fixed: DataFrame, findings: DataFrame, files: DataFrame) -> DataFrame:
    """Original path of each fixed file name: the first finding of that name in report order,
    else the first file of that name. First entries come from min_by, so a common name
    shrinks before the shuffle."""
    order = F.struct(scalars.report_rank(F.col("severity")), "file_path", "line", "seq")
    from_findings = findings.groupBy(text.basename(F.col("file_path")).alias("filename")).agg(
        F.min_by("file_path", order).alias("_finding_path"))
    from_files = files.groupBy(text.basename(F.col("file_path")).alias("filename")).agg(
        F.min("file_path").alias("_file_path"))
    names = fixed.select(text.basename(F.col("file_path")).alias("filename")).distinct()
    with_finding = sized_join(names, from_findings, "filename", "left")
    return (sized_join(with_finding, from_files, "filename", "left")
            .select("filename", F.coalesce("_finding_path", "_file_path").alias("original_path")))


def seq_pairs(files: DataFrame, first: str, second: str, max_gap: int, same_argument: bool = False) -> DataFrame:
    """For each match of ``first``, the nearest match of ``second`` that starts at most
    ``max_gap`` characters after its end (with ``same_argument``, of equal group 1).

    Inside the file's row: the matches of both patterns are sorted by argument and place and cut
    behind each match of ``second``; all firsts of a piece have that one as their partner."""
    code = F.col("_code")

    def located(pattern: str, kind: int) -> Column:
        p = "(?dU)" + pattern
        hits = F.regexp_extract_all(code, F.lit(p), F.lit(0))
        args = F.regexp_extract_all(code, F.lit(p), F.lit(1)) if same_argument else F.transform(hits, lambda m: F.lit(""))
        steps = F.zip_with(F.slice(F.split(code, p, -1), 1, F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("bigint"))
        spot = lambda end, h: F.struct(end.alias("end"), F.length(h).cast("bigint").alias("len"))
        found = text.let(hits, lambda hs: F.zip_with(running(steps), hs, spot))
        # a first counts from its end; at one place firsts come before seconds
        return F.zip_with(found, args, lambda x, a: F.struct(
            a.alias("arg"), (x["end"] if kind == 0 else x["end"] - x["len"]).alias("pos"), F.lit(kind).alias("kind"),
            (x["end"] - x["len"]).alias("start"), x["end"].alias("end")))

    def pairs(run: Column) -> Column:
        last = F.element_at(run, -1)
        near = F.filter(run, lambda x: (x["kind"] == 0) & (last["start"] - x["end"] <= max_gap))
        return F.when(last["kind"] == 1, F.transform(near, lambda x: F.struct(
            x["arg"].alias("arg"), x["start"].alias("first_start"), x["end"].alias("first_end"), last["start"].alias("second_start")))).otherwise(
            F.array().cast("array<struct<arg:string,first_start:bigint,first_end:bigint,second_start:bigint>>"))

    prepared = files.select("file_path", text.neutralize(F.col("code")).alias("_code"))
    hits = prepared.select("file_path", F.concat(located(first, 0), located(second, 1)).alias("_hits"))
    whole = runs(F.sort_array("_hits"), lambda before, x: (before["kind"] == 1) | (before["arg"] != x["arg"]), pairs)
    return hits.select("file_path", F.inline(F.flatten(whole)))
