"""Rule scan: all rules over all files in one narrow pass (no shuffle).

A hit is (line, dim, function_name): ``dim`` is the position of its rule or signature among
those of the scan, and the place of a hit in its file's array is the order in which the
detectors emit it. As a row, a finding keeps that place as ``seq``.

Rules that are a plain call of one function share one pass over the text: at one place only one
function can be called, so their matches never overlap. Each other rule takes one pass, and only
over texts that hold its key word.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, text
from ..functions.dims import RULES, Rule

HIT = "array<struct<line:int,dim:int,function_name:string>>"
PLAIN_CALL = re.compile(r"\\b([A-Za-z_]\w*)\\s\*\\\(")  # a pattern like \bname\s*\(
LEADING_CALL = re.compile(r"\\b([A-Za-z_]\w*)\\s\*\\\((?![?*{])(?!.*\|)")  # one that begins so, without a branch


def java_pattern(pattern: str) -> str:
    """Give a rule's pattern the meaning its author's regex dialect has. What a call begins with is
    asked first: at most places that is all, and a word's bound costs several times as much."""
    named = LEADING_CALL.match(pattern) or PLAIN_CALL.fullmatch(pattern)
    return "(?dU)" + (f"(?={named[1][0]})" if named else "") + dims.java_dialect(pattern)


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _gate(rule: Rule) -> str:
    gate = f"language IN ({', '.join(sql_text(x) for x in rule.languages)})"
    return gate + (f" AND contains(_code, {sql_text(rule.needle)})" if rule.needle else "")


def sql_let(value: str, name: str, body: str) -> str:
    """``text.let`` as SQL."""
    return f"aggregate(CAST(array() AS array<int>), {value}, (kept, _) -> kept, {name} -> {body})"


def _fenced(pattern: str) -> str:
    return f"regexp_replace(_code, {sql_text(pattern)}, concat({MARK}, '$0', {END}))"


MARK, END = sql_text(text.MARK), sql_text(text.MARK_END)
#: Line of each mark of the fenced text t.
LINES = f"""flatten(transform(split(t, '\\n', -1), (s, i) -> array_repeat(i + 1, IF(contains(s, {MARK}),
    length(s) - length(replace(s, {MARK}, '')), 0))))"""
FEW = 4  # marks whose lines are counted from the start of the text each; more are counted line by line
PLACES = f"""CASE WHEN NOT contains(t, {MARK}) THEN CAST(array() AS array<int>)
    WHEN octet_length(t) - octet_length(replace(t, {MARK}, '')) <= {FEW} THEN transform(
      sequence(1, octet_length(t) - octet_length(replace(t, {MARK}, ''))), k -> aggregate(CAST(array() AS array<int>),
        substring_index(t, {MARK}, k), (kept, _) -> kept, s -> 1 + octet_length(s) - octet_length(replace(s, '\n', ''))))
    ELSE {LINES} END"""
#: The matches of the fenced text t.
MATCHES = f"filter(transform(split(t, {MARK}, -1), p -> substring_index(p, {END}, 1)), (p, i) -> i > 0)"


def rule_hits(rule: Rule, dim: int) -> str:
    """SQL for the array of this rule's hits in ``_code``, the neutralized text.

    A pack holds many rules, so each is one SQL text instead of dozens of column calls. The
    function name is the first called name of the match; a pattern that begins with one tells it."""
    named = LEADING_CALL.match(rule.pattern)
    if named:
        hits = f"transform({PLACES}, n -> struct(n AS line, {dim} AS dim, {sql_text(named[1])} AS function_name))"
    else:
        hits = f"""zip_with({PLACES}, {MATCHES}, (n, m) -> struct(n AS line, {dim} AS dim,
          regexp_extract(m, {sql_text(text.CALL_NAME)}, 1) AS function_name))"""
    return f"CASE WHEN {_gate(rule)} THEN {sql_let(_fenced(java_pattern(rule.pattern)), 't', hits)} ELSE CAST(array() AS {HIT}) END"


def plain_calls(names: Sequence[str]) -> str:
    """SQL for the line ``n`` and name ``m`` of all plain calls of these functions, in text order."""
    words = " OR ".join(f"contains(_code, {sql_text(name)})" for name in names)
    first = "".join(dict.fromkeys(name[0] for name in names))
    pattern = rf"(?dU)(?=[{first}])\b({'|'.join(names)})(\s*\()"
    fenced = f"regexp_replace(_code, {sql_text(pattern)}, concat({MARK}, '$1', {END}, '$2'))"
    found = f"zip_with({PLACES}, {MATCHES}, (n, m) -> struct(n, m))"
    return f"CASE WHEN {words} THEN {sql_let(fenced, 't', found)} ELSE CAST(array() AS array<struct<n:int,m:string>>) END"


def plain_call_hits(rule: Rule, dim: int, name: str) -> str:
    """SQL for the hits of a rule that is a plain call, from the ``plain_calls`` h."""
    return f"transform(filter(h, x -> x.m = {sql_text(name)} AND {_gate(rule)}), x -> struct(x.n AS line, {dim} AS dim, x.m AS function_name))"


def all_rule_hits(rules: Sequence[Rule], base: int = 0) -> Column:
    """Hits of all rules in ``_code``, rule after rule, as one array."""
    named = {i: m[1] for i, r in enumerate(rules) if (m := PLAIN_CALL.fullmatch(r.pattern))}
    arrays = [plain_call_hits(r, base + i, named[i]) if i in named else rule_hits(r, base + i) for i, r in enumerate(rules)]
    whole = f"concat({', '.join(arrays or [f'CAST(array() AS {HIT})'])})"
    return F.expr(sql_let(plain_calls(list(dict.fromkeys(named.values()))), "h", whole) if named else whole)


def rule_findings(files: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """files(file_path, language, code) -> file_path, language, seq, line, dim, function_name."""
    rules = dims.usable_rules(rules)
    prepared = files.select("file_path", "language", text.scan_text(F.col("code")).alias("_code"))
    return hit_rows(prepared, all_rule_hits(rules))


def rule_counts(files: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """``dim`` and ``n``, the number of hits of each rule that has any. As many as ``rule_findings``
    gives, but no hit is placed or named: each rule's matches are counted, over texts with its key word."""
    rules = dims.usable_rules(rules)
    texts = files.select("language", text.scan_text(F.col("code")).alias("_code"))
    sums = texts.agg(*[F.sum(F.expr(f"CASE WHEN {_gate(r)} THEN regexp_count(_code, {sql_text(java_pattern(r.pattern))}) END")).alias(f"n{i}")
                       for i, r in enumerate(rules)], F.count("*").alias("files"))
    counts = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"n{i}").alias("n")) for i in range(len(rules))])
    return sums.select(F.inline(counts.cast("array<struct<dim:int,n:bigint>>"))).where("n > 0")


def hit_rows(files: DataFrame, hits: Column) -> DataFrame:
    """One row for each hit of each file."""
    return files.select("file_path", "language", F.posexplode(hits).alias("seq", "h")).select(
        "file_path", "language", "seq", "h.line", "h.dim", "h.function_name")


def describe(findings: DataFrame, dim: DataFrame) -> DataFrame:
    """Attach rule texts to slim findings (broadcast join with the scan's own rules)."""
    d = F.broadcast(dim)
    return findings.join(d, findings["dim"] == d["dim_idx"]).drop("dim", "dim_idx", "type_key", "category")


def scan_rules(files: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    rules = dims.usable_rules(rules)
    spark = files.sparkSession
    return describe(rule_findings(files, rules), dims.finding_dim(spark, rules))
