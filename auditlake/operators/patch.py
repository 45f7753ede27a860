"""Line edits as data: fix templates, fixed files, splices and diffs.

A file is edited inside its own row, which carries its findings (``merge.scan_files``): its text
is an array of lines, each line a block that templates may grow. Running sums of that growth map
every line of the original to its place in the fixed text, which is how the second tier, answers
from a review, finds its windows.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, text
from ..functions.arrays import running
from ..functions.text import let
from ..session import remembered
from .analyze import extended, fields_of, held, with_snippet
from .assist import FIX_PROMPT, SNIPPET_PROMPT, clean_response, fill, finding_id
from .merge import detect_all, in_row


class Template(NamedTuple):
    """How to rewrite a line that calls one of ``functions``. ``replacement`` may name the pattern's
    groups as {1}, {2}, ... (without the blanks around them) and the line's {indent}; a group
    marked as {1!} is taken as it is. It replaces the whole line, or only the match."""

    functions: tuple[str, ...]
    pattern: str
    replacement: str
    whole_line: bool = True


# What each template matches and what it writes.
TWO_ARGS = r"\b{fn}\s*\(\s*([^,]+)\s*,\s*([^)]+)\s*\)"
REST_ARGS = r"\b{fn}\s*\(\s*([^,]+)\s*,\s*(.+)\s*\)"
TEMPLATES = [
    Template(("gets",), r"\bgets\s*\(\s*([^)]+)\s*\)", "fgets({1}, sizeof({1}), stdin)", False),
    Template(("strcpy",), TWO_ARGS.format(fn="strcpy"),
             "{indent}strncpy({1}, {2}, sizeof({1}) - 1);\n{indent}{1}[sizeof({1}) - 1] = '\\0';"),
    Template(("strcat",), TWO_ARGS.format(fn="strcat"), "{indent}strncat({1}, {2}, sizeof({1}) - strlen({1}) - 1);"),
    Template(("sprintf",), REST_ARGS.format(fn="sprintf"), "{indent}snprintf({1}, sizeof({1}), {2});"),
    Template(("vsprintf",), REST_ARGS.format(fn="vsprintf"), "{indent}vsnprintf({1}, sizeof({1}), {2});"),
    Template(("scanf",), r'(\bscanf\s*\(\s*"[^"]*)%s([^"]*")', "{1!}%255s{2!}", False),
    Template(("wcscpy",), TWO_ARGS.format(fn="wcscpy"),
             "{indent}wcsncpy({1}, {2}, sizeof({1})/sizeof({1}[0]) - 1);\n"
             "{indent}{1}[sizeof({1})/sizeof({1}[0]) - 1] = L'\\0';"),
]
FIELD = re.compile(r"\{(\d+!?|indent)\}")
SEPARATOR = "\u0006"


def usable_templates(templates: Sequence[Template]) -> list[Template]:
    """Leave out templates whose pattern does not compile in both dialects or that name a group
    the pattern lacks, with a warning that tells which."""
    spark = SparkSession.getActiveSession()
    kept = []
    for t in templates:
        try:
            groups = re.compile(t.pattern).groups
            if any(f != "indent" and int(f.rstrip("!")) > groups for f in FIELD.findall(t.replacement)):
                raise re.error("the replacement names a group that the pattern lacks")
            if spark is not None and t not in TEMPLATES:
                spark._jvm.java.util.regex.Pattern.compile("(?dU)" + dims.java_dialect(t.pattern))
        except (re.error, IllegalArgumentException) as problem:
            warnings.warn(f"template for {', '.join(t.functions)} is left out: {str(problem).splitlines()[0]}", stacklevel=2)
            continue
        kept.append(t)
    return kept


def template_fix(line: Column, template: Template) -> Column:
    """``line`` rewritten by a template, null where its pattern does not match.

    One regex pass: the first match comes out with its groups behind it, all cut at marks."""
    fields = list(dict.fromkeys(f for f in FIELD.findall(template.replacement) if f != "indent"))
    shown = "".join(f"{SEPARATOR}${f.rstrip('!')}" for f in fields)
    pattern = "(?dU)" + dims.java_dialect(template.pattern)
    fenced = lambda t: F.split(F.regexp_replace(t, F.lit(pattern), F.lit(f"{text.MARK}$0{shown}{text.MARK_END}")), text.MARK, 2)

    def rewritten(t: Column, parts: Column) -> Column:
        match = F.split(F.substring_index(F.get(parts, F.lit(1)), text.MARK_END, 1), SEPARATOR, -1)

        def build(m: Column) -> Column:
            values = {"indent": F.regexp_extract(t, r"(?dU)^(\s*)", 1)}
            for i, f in enumerate(fields):
                values[f] = F.get(m, F.lit(i + 1)) if f.endswith("!") else text.strip(F.get(m, F.lit(i + 1)))
            new = _filled(template.replacement, values)
            if template.whole_line:
                return new
            behind = F.length(F.get(parts, F.lit(0))) + F.length(F.get(m, F.lit(0))) + 1
            return F.concat(F.get(parts, F.lit(0)), new, F.substring(t, behind, F.length(t)))

        return F.when(F.size(parts) > 1, let(match, build))

    return let(text.unmark(line), lambda t: let(fenced(t), lambda parts: rewritten(t, parts)))


def _filled(template: str, values: dict[str, Column]) -> Column:
    out, at = [], 0
    for m in FIELD.finditer(template):
        if m.start() > at:
            out.append(F.lit(template[at:m.start()]))
        out.append(values[m[1]])
        at = m.end()
    if at < len(template):
        out.append(F.lit(template[at:]))
    return F.concat(*out) if out else F.lit("")


def try_template_fix(line: Column, function_name: Column, templates: Sequence[Template] = TEMPLATES) -> Column:
    """The first template of the named function that fits the line; without a name the first of all."""
    fn = F.lower(F.coalesce(function_name, F.lit("")))
    tries = [F.when((fn == "") | fn.isin(*t.functions), template_fix(line, t)) for t in templates]
    return F.coalesce(*tries, F.lit(None).cast("string"))


def can_template_fix(function_name: Column, templates: Sequence[Template] = TEMPLATES) -> Column:
    names = sorted({f for t in templates for f in t.functions})
    return F.lower(F.coalesce(function_name, F.lit(""))).isin(names)


def fix_split_counts(findings: DataFrame) -> DataFrame:
    fixable = can_template_fix(F.col("function_name"))
    return findings.agg(F.count_if(fixable).alias("template_fixes"),
                        F.count_if(~fixable).alias("other_fixes"))


# ---------------------------------------------------------------- first tier: templates

@remembered
def _edits(templates: tuple[Template, ...]) -> Column:
    return F.transform(F.filter("findings", lambda f: can_template_fix(f["function_name"], templates)), lambda f: F.struct(
        f["line"].alias("line"), f["seq"].cast("bigint").alias("seq"), f["function_name"].alias("function_name")))


@remembered
def _blocks(templates: tuple[Template, ...]) -> Column:
    def step(state: Column, edit: Column) -> Column:
        head = F.substring_index(state["text"], "\n", 1)
        return let(F.struct(try_template_fix(head, edit["function_name"], templates).alias("new"), head.alias("old")),
                   lambda h: F.when(h["new"].isNotNull(), F.struct(
                       F.concat(h["new"], F.substring(
                           state["text"], F.length(h["old"]) + 1, F.length(state["text"]))).alias("text"),
                       F.array_append(state["applied"], edit["seq"]).alias("applied"))).otherwise(state))

    none = F.array().cast("array<bigint>")

    def block(line: Column, i: Column) -> Column:
        start = F.struct(line.alias("text"), none.alias("applied"))
        here = F.filter("_edits", lambda e: e["line"] == i + 1)
        return F.when(F.exists("_edits", lambda e: e["line"] == i + 1), F.aggregate(here, start, step)).otherwise(start)

    return F.transform(text.lines_of(F.col("code")), block)


@remembered
def _grown() -> Column:
    return F.when(F.size("applied") == 0, F.array().cast("array<bigint>")).otherwise(
        running(F.transform("blocks", lambda b: text.count_char(b, "\n").cast("bigint"))))


def _templated(files: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """Files with ``blocks``, one text per original line, ``applied``, the order keys of the
    findings whose template matched, and ``grown``, running sums of the lines that blocks gained.
    Edits of one line follow each other on its first line."""
    rows = files.withColumn("_edits", _edits(tuple(templates)))
    rows = in_row(rows, "_b", _blocks(tuple(templates))).drop("_edits")
    rows = rows.withColumns({"blocks": F.transform("_b", lambda b: b["text"]),
                             "applied": F.flatten(F.transform("_b", lambda b: b["applied"]))}).drop("_b")
    return rows.withColumn("grown", _grown())


def moved(line: Column) -> Column:
    """Where a line of the original stands in the text of ``blocks``."""
    before = F.get("grown", F.least(line - 2, F.size("grown") - 1))
    return (line + F.coalesce(before, F.lit(0).cast("bigint"))).cast("int")


def apply_templates(files: DataFrame, findings: DataFrame | None = None, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """The files that have a finding with a template, with ``blocks``, ``applied`` and ``grown``.
    ``files`` carry their findings, unless these come as a table."""
    templates = usable_templates(templates)
    fixable = F.exists("findings", lambda f: can_template_fix(f["function_name"], templates))
    return _templated(held(files, findings).where(fixable & F.col("code").isNotNull()), templates)


def _changed(rows: DataFrame, fixed: Column) -> DataFrame:
    """The rows whose text differs by more than white space around it, with ``fixed_code``."""
    # a generator of none or one row: a filter would be pushed down and fix every text twice
    changed = F.filter(F.array(F.struct(fixed.alias("fixed_code"))), lambda r: text.strip(r["fixed_code"]) != text.strip(F.col("code")))
    return rows.select(*rows.columns, F.inline(changed))


def fix_files(files: DataFrame, findings: DataFrame | None = None, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Files whose text the templates change, with ``fixed_code``."""
    return _changed(apply_templates(files, findings, templates), F.array_join("blocks", "\n"))


def all_fixed(files: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """All files, those that the templates change with ``fixed_code``, the others with a null."""
    rows = _templated(files, usable_templates(templates))
    whole = in_row(rows, "_t", F.array_join("blocks", "\n"))
    changed = F.when(text.strip(F.col("_t")) != text.strip(F.col("code")), F.col("_t"))
    return whole.withColumn("fixed_code", changed).drop("_t", "blocks", "applied", "grown")


def line_shift(files: DataFrame, findings: DataFrame | None = None, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """The findings with ``fixed_line``: where they stand after the fixed lines above have grown."""
    rows = held(files, findings).where(F.col("code").isNotNull())
    fields = fields_of(rows)
    rows = _templated(rows, usable_templates(templates))
    return rows.select("file_path", F.inline(F.transform("findings", lambda f: extended(f, fields, fixed_line=moved(f["line"]))))).drop("rank")


# ---------------------------------------------------------------- second tier: answers of a review

def remaining(files: DataFrame, findings: DataFrame | None = None, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """All files with findings after the first tier: ``code`` is the text that the templates leave,
    ``original`` the one before, and ``findings`` those that no template took care of, at their
    new lines (``original_line`` has the old one)."""
    rows = held(files, findings).where((F.size("findings") > 0) & F.col("code").isNotNull())
    fields = fields_of(rows)
    rows = _templated(rows, usable_templates(templates))
    rows = rows.withColumnsRenamed({"code": "original", "findings": "_f"}).withColumn("_left", F.struct(
        F.array_join("blocks", "\n").alias("code"), F.transform(F.filter("_f", lambda f: ~F.array_contains("applied", f["seq"].cast("bigint"))), lambda f: extended(
            f, fields, line=moved(f["line"]), original_line=f["line"])).alias("findings")))
    return rows.drop("_f", "blocks", "applied", "grown").select("*", "_left.*").drop("_left")


def remaining_findings(files: DataFrame, findings: DataFrame | None = None, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """What a reviewer or a model has to look at, one row per finding."""
    return remaining(files, findings, templates).select("file_path", F.inline("findings")).drop("rank")


def fix_prompts(left: DataFrame) -> DataFrame:
    """Prompts for what ``remaining`` leaves, over the text that the templates leave."""
    return _fix_prompts(left, FIX_PROMPT)


def snippet_prompts(left: DataFrame) -> DataFrame:
    return _fix_prompts(left, SNIPPET_PROMPT)


def _fix_prompts(left: DataFrame, template: str) -> DataFrame:
    asked = with_snippet(left)
    return asked.withColumn("line", F.col("original_line")).select(finding_id().alias("finding_id"), fill(template).alias("prompt"))


def _bottom_up(fields: Sequence[str]) -> Column:
    """The findings that have an answer, last line first, ties in report order."""
    return F.sort_array(F.transform("findings", lambda f, i: F.struct((-f["line"]).alias("down"), i.alias("i"), *[f[c].alias(c) for c in fields])))


def _splice(lines: Column, start: Column, end: Column, new: Column) -> Column:
    return F.concat(F.slice(lines, 1, F.least(start, F.size(lines))), new,
                    F.slice(lines, F.greatest(start, end) + 1, F.size(lines)))


def spliced(code: Column, window: int = 5) -> Column:
    """``code`` with the answers (``response`` of the row's findings) in place of their windows,
    bottom up; empty answers and answers far from the window's size are skipped."""

    def step(lines: Column, f: Column) -> Column:
        start = F.greatest(F.lit(0), f["line"] - 1 - window)
        end = F.least(F.size(lines), f["line"] + window)
        count = end - start

        def fits(answer: Column) -> Column:
            new = text.lines_of(answer)
            ok = ((answer != "") & (F.size(new) >= count * F.lit(0.3)) & (F.size(new) <= count * 3))
            return F.when(ok, _splice(lines, start, end, new)).otherwise(lines)

        return let(clean_response(f["response"]), fits)

    have = F.filter(_bottom_up(["line", "response"]), lambda f: f["response"].isNotNull())
    return F.array_join(F.aggregate(have, text.lines_of(code), step), "\n")


def snippet_splice(files: DataFrame, findings: DataFrame | None = None, window: int = 5) -> DataFrame:
    """Files with answers (findings with a ``response``), and ``fixed_code`` after splicing them."""
    have = held(files, findings).where(F.exists("findings", lambda f: f["response"].isNotNull()) & F.col("code").isNotNull())
    return in_row(have, "fixed_code", spliced(F.col("code"), window))


def fix_two_tiers(left: DataFrame, window: int = 5) -> DataFrame:
    """From ``remaining``, its findings with a ``response`` where there is an answer, to one fixed
    text per file: file_path, language, code (the original), fixed_code. Files that neither
    templates nor answers change are left out."""
    rows = in_row(left.withColumnRenamed("code", "_templated"), "_fixed", spliced(F.col("_templated"), window))
    return _changed(rows.withColumnRenamed("original", "code"), F.col("_fixed")).select("file_path", "language", "code", "fixed_code")


def apply_llm_fix(files: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Replace the window around each finding that carries ``llm_fix``, bottom up."""
    have = held(files, findings).where(F.exists("findings", lambda f: F.coalesce(f["llm_fix"], F.lit("")) != "")
                                       & (F.coalesce("code", F.lit("")) != ""))

    def step(lines: Column, f: Column) -> Column:
        start = F.greatest(F.lit(0), f["line"] - 6)
        end = F.least(F.size(lines), f["line"] + 5)
        return _splice(lines, start, end, text.lines_of(f["llm_fix"]))

    fixes = F.filter(_bottom_up(["line", "llm_fix"]), lambda f: F.coalesce(f["llm_fix"], F.lit("")) != "")
    return in_row(have, "fixed_code", F.array_join(F.aggregate(fixes, text.lines_of(F.col("code")), step), "\n"))


def patch_one(files: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """``patch`` of each finding: its window removed line by line, ``llm_fix`` added."""
    rows = with_snippet(held(files, findings))
    old, new = text.lines_of(F.col("snippet")), text.lines_of(F.col("llm_fix"))
    name = text.basename(F.col("file_path"))
    start = F.greatest(F.lit(1), F.col("line") - 5)
    sign = lambda s, lines: F.transform(lines, lambda x: F.concat(F.lit(s), x))
    body = F.array_join(F.concat(
        F.array(F.concat(F.lit("--- a/"), name), F.concat(F.lit("+++ b/"), name),
                F.format_string("@@ -%d,%d +%d,%d @@", start, F.size(old), start, F.size(new))),
        sign("-", old), sign("+", new)), "\n")
    return rows.withColumn("patch", F.when(F.coalesce("llm_fix", F.lit("")) != "", body).otherwise("")).drop("snippet")


def rescan_high(fixed: DataFrame) -> DataFrame:
    """Detect again on the fixed texts; high and critical findings only."""
    again = fixed.select("file_path", "language", F.col("fixed_code").alias("code"))
    return detect_all(again).where(F.col("severity").isin("critical", "high"))


# ---------------------------------------------------------------- diffs

def _changes(patched: DataFrame) -> DataFrame:
    changed = F.filter(
        F.zip_with(text.lines_of(F.col("code")),
                   F.transform("blocks", lambda b, i: F.struct(b.alias("new"), (i + 1).alias("line"))),
                   lambda old, b: F.struct(b["line"].alias("line"), old.alias("old"), b["new"].alias("new"))),
        lambda c: c["old"] != c["new"])
    return patched.withColumn("changes", changed)


def patch_lines(patched: DataFrame) -> DataFrame:
    """Edit table: file_path, line, ordinal, op, text; removed line first, then its new lines."""
    rows = F.flatten(F.transform(F.col("changes"), lambda c: F.concat(
        F.array(F.struct(c["line"].alias("line"), F.lit(0).alias("ordinal"), F.lit("-").alias("op"),
                         c["old"].alias("text"))),
        F.transform(text.lines_of(c["new"]), lambda t, i: F.struct(
            c["line"].alias("line"), (i + 1).alias("ordinal"), F.lit("+").alias("op"), t.alias("text"))))))
    return _changes(patched).select("file_path", F.inline(rows))


def patch_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file_path").agg(
        F.count_if(F.col("op") == "+").alias("additions"), F.count_if(F.col("op") == "-").alias("deletions"))


CONTEXT = 3


def unified_diff(patched: DataFrame) -> DataFrame:
    """file_path, filename, hunks, diff, additions, deletions of the files in ``fix_files``.

    Changed lines whose contexts touch share a hunk; offsets follow the growth before it."""
    with_changes = _changes(patched)
    hunk = lambda first, last: F.struct(first.alias("first"), last.alias("last"))

    def grow(hunks: Column, c: Column) -> Column:
        last = F.element_at(hunks, -1)
        near = (F.size(hunks) > 0) & (c["line"] - last["last"] <= 2 * CONTEXT + 1)
        return F.when(near, F.concat(F.slice(hunks, 1, F.size(hunks) - 1),
                                     F.array(hunk(last["first"], c["line"])))).otherwise(
            F.array_append(hunks, hunk(c["line"], c["line"])))

    empty = F.array().cast("array<struct<first:int,last:int>>")
    # element_at of an empty array must not fail, so the fold starts from the first change
    first = F.get("changes", F.lit(0))["line"]
    hunks = F.aggregate(F.slice("changes", 2, F.greatest(F.size("changes") - 1, F.lit(0))),
                        F.concat(empty, F.array(hunk(first, first))), grow)
    plus = lambda lines: F.transform(text.lines_of(lines), lambda t: F.concat(F.lit("+"), t))
    delta = lambda c: text.count_char(c["new"], "\n")

    def render(h: Column) -> Column:
        lines = text.lines_of(F.col("code"))
        start = F.greatest(F.lit(1), h["first"] - CONTEXT)
        end = F.least(F.size(lines), h["last"] + CONTEXT)
        inside = F.filter("changes", lambda c: (c["line"] >= h["first"]) & (c["line"] <= h["last"]))
        before = F.aggregate(F.filter("changes", lambda c: c["line"] < h["first"]), F.lit(0),
                             lambda a, c: a + delta(c))
        growth = F.aggregate(inside, F.lit(0), lambda a, c: a + delta(c))
        changed = lambda n: F.exists(inside, lambda c: c["line"] == n)
        # the changes of the run of changed lines that ends with line n
        run = lambda n: F.filter(inside, lambda c: (c["line"] <= n) & (F.size(F.filter(
            inside, lambda x: (x["line"] > c["line"]) & (x["line"] <= n))) == n - c["line"]))
        body = F.flatten(F.transform(F.sequence(start, end), lambda n: F.concat(
            F.array(F.concat(F.when(changed(n), "-").otherwise(" "), F.col("lines")[n - 1])),
            F.when(changed(n) & ~changed(n + 1), F.flatten(F.transform(run(n), lambda c: plus(c["new"]))))
            .otherwise(F.array().cast("array<string>")))))
        size = end - start + 1
        span = lambda at, n: F.concat(at.cast("string"), F.when(n != 1, F.concat(
            F.lit(","), n.cast("string"))).otherwise(""))
        header = F.concat(F.lit("@@ -"), span(start, size), F.lit(" +"), span(start + before, size + growth), F.lit(" @@"))
        return F.concat(header, F.lit("\n"), F.array_join(body, "\n"))

    name = text.basename(F.col("file_path"))
    counted = with_changes.withColumns(
        {"lines": text.lines_of(F.col("code")), "hunks": hunks})
    return counted.select(
        "file_path", name.alias("filename"), F.size("hunks").cast("bigint").alias("hunks"),
        F.concat(F.lit("--- original/"), name, F.lit("\n+++ fixed/"), name, F.lit("\n"),
                 F.array_join(F.transform("hunks", render), "\n")).alias("diff"),
        F.aggregate("changes", F.lit(0), lambda a, c: a + delta(c) + 1).cast("bigint").alias("additions"),
        F.size("changes").cast("bigint").alias("deletions"))


def text_diff(old: Column, new: Column) -> Column:
    """Unified diff of any two texts, three lines of context, without file headers; empty where the
    lines are equal. Line matching has no counterpart among SQL functions: a small helper of
    Python's own ``difflib`` takes it, batch by batch."""
    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib

        one = lambda x, y: None if x is None or y is None else "\n".join(
            list(difflib.unified_diff(x.split("\n"), y.split("\n"), lineterm=""))[2:])
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="object")

    return diff(old, new)


def fix_record(fixed: DataFrame, output_dir: str) -> DataFrame:
    """The record of each fixed file (``code`` and ``fixed_code``): filename, original_path,
    fixed_path, diff, additions, deletions and whether it was put in place."""
    name = text.basename(F.col("file_path"))
    body = in_row(fixed, "_diff", text_diff(F.col("code"), F.col("fixed_code")))
    lines = text.lines_of(F.col("_diff"))
    # three signs in a row look like a file header and do not count
    count = lambda sign: F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(sign * 3)))).cast("bigint")
    return body.select(
        name.alias("filename"), F.col("file_path").alias("original_path"), F.concat(F.lit(output_dir.rstrip("/") + "/"), name).alias("fixed_path"),
        F.when(F.col("_diff") == "", "(new file or identical)").otherwise(F.concat(
            F.lit("--- original/"), name, F.lit("\n+++ fixed/"), name, F.lit("\n"), F.col("_diff"))).alias("diff"),
        count("+").alias("additions"), count("-").alias("deletions"), F.lit(False).alias("applied"))
