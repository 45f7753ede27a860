"""Review steps around a language model: prompts out, answers in. No model is called here;
answers are a table, or the result of a function the user passes to ``answer``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import sized_join
from .analyze import extended, fields_of, held, with_snippet

# ---------------------------------------------------------------------------
# The prompt texts.
# ---------------------------------------------------------------------------
REASON_PROMPT = """You are a C/C++ security expert.

Analyze this code snippet for the reported vulnerability.

Respond in EXACTLY this format (no extra text):
Confirmed: YES or NO
Vulnerability: <one-line summary>
Reason: <1-2 sentences explaining why this is dangerous>
Severity: CRITICAL / HIGH / MEDIUM / LOW

Code:
{snippet}

Reported issue: {vuln_type} ({cwe_id})
"""
FIX_PROMPT = """You are a C/C++ security expert.

Fix the vulnerability in this code snippet.

Rules:
- Return ONLY the corrected code
- No explanations, no markdown fences
- Keep changes minimal — fix only the vulnerability
- Preserve original logic and formatting

Code:
{snippet}

Vulnerability: {vuln_type} ({cwe_id})
"""
SNIPPET_PROMPT = """You are a C/C++ security expert.
Fix the vulnerability in this code snippet.

RULES:
1. Return ONLY the fixed code snippet — same number of lines or fewer
2. No markdown fences, no explanations, no text before or after
3. Keep changes minimal — fix ONLY the vulnerability
4. Preserve original indentation and formatting

Vulnerability: {vuln_type} ({cwe_id})
  → {recommendation}

Code:
{snippet}"""
BATCH_PROMPT = """You are a C/C++ security expert.

Analyze these reported vulnerabilities in the code below.
For EACH issue, respond on one line in this format:
Line <N>: CONFIRMED/REJECTED — <short reason>

Issues:
{issues}

Code:
{snippet}
"""
CUT_MARKERS = ["explanation:", "note:", "this fix", "the fix", "changes made:"]
CONFIRM_BOOST = 0.25
REJECT_CUT = 0.3

_BLANKS = text.SPACE.replace(r"\n", "")
FENCE = rf"(?dm)^[{_BLANKS}]*```[^\n]*(?:\n|\z)"
CUT = rf"(?dmi)^[{_BLANKS}]*(?:{'|'.join(CUT_MARKERS)})[\s\S]*"


def fill(template: str) -> Column:
    """A prompt with its {fields} taken from the columns of the same name."""
    parts: list[Column] = []
    for piece in template.replace("{", "\0{").replace("}", "\0").split("\0"):
        if piece.startswith("{"):
            parts.append(F.col(piece[1:]))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def finding_id() -> Column:
    """Unique among merged findings."""
    return F.concat_ws(":", "file_path", "rule_id", "function_name", "line")


def id_in(f: Column, fields: Sequence[str]) -> Column:
    """``finding_id`` of a finding in its file's row, whose line may have moved."""
    line = f["original_line" if "original_line" in fields else "line"]
    return F.concat_ws(":", F.col("file_path"), f["rule_id"], f["function_name"], line.cast("string"))


def reason_prompts(files: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """finding_id and prompt of each finding of files that carry theirs (or of a table)."""
    return with_snippet(held(files, findings)).select(finding_id().alias("finding_id"), fill(REASON_PROMPT).alias("prompt"))


def batch_prompts(files: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One prompt per file with all its issues in line order over the whole text."""
    issue = lambda f: F.struct(f["line"].alias("line"), f["seq"].alias("seq"), F.concat(
        F.lit("  - Line "), f["line"].cast("string"), F.lit(": "), f["vuln_type"], F.lit(" ("), f["cwe_id"], F.lit(")")).alias("text"))
    issues = F.array_join(F.transform(F.sort_array(F.transform("findings", issue)), lambda i: i["text"]), "\n")
    asked = held(files, findings).where((F.size("findings") > 0) & F.col("code").isNotNull())
    return asked.select("file_path", F.col("code").alias("snippet"), issues.alias("issues")).select(
        "file_path", fill(BATCH_PROMPT).alias("prompt"))


def with_answers(files: DataFrame, response: Callable[[Column, Column], Column], name: str = "response") -> DataFrame:
    """The findings of each file with a further field, ``response(finding_id, finding)``."""
    fields = fields_of(files)
    return files.withColumn("findings", F.transform("findings", lambda f: extended(f, fields, **{name: response(id_in(f, fields), f)})))


def join_answers(files: DataFrame, answers: DataFrame, name: str = "response") -> DataFrame:
    """The same from a table of ``finding_id`` and ``response`` (the greatest of several): answers
    are gathered by file and meet the texts on their path, the one step that shuffles texts."""
    answers = answers.groupBy("finding_id").agg(F.max(name).alias(name))
    fields = fields_of(files)
    key = files.select("file_path", F.explode("findings").alias("f")).select("file_path", id_in(F.col("f"), fields).alias("finding_id")).distinct()
    by_file = sized_join(answers.select("finding_id", F.col(name).alias("_a")).where("_a IS NOT NULL"), key, "finding_id").groupBy(
        "file_path").agg(F.map_from_entries(F.collect_list(F.struct("finding_id", "_a"))).alias("_answers"))
    joined = sized_join(files, by_file, "file_path", "left")
    return joined.withColumn("findings", F.transform("findings", lambda f: extended(
        f, fields, **{name: F.try_element_at("_answers", id_in(f, fields))}))).drop("_answers")


def answer(prompts: DataFrame, generate: Callable[[str], str], key: str = "finding_id") -> DataFrame:
    """Run a user's function over the prompts, in batches on the executors. A failing call
    gives a null response and its message."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def call(prompt: str) -> tuple[str | None, str | None]:
            try:
                return generate(prompt), None
            except Exception as problem:  # the user's function may raise anything
                return None, str(problem)

        for batch in batches:
            replies = [call(p) for p in batch["prompt"]]
            yield pd.DataFrame({key: batch[key], "response": [r for r, _ in replies],
                                "error": [e for _, e in replies]})

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} string, response string, error string")


def clean_response(response: Column) -> Column:
    """Take the code out of an answer: inside fences if there are any, up to a closing remark."""

    def unfence(t: Column) -> Column:
        inside = F.filter(F.transform(F.split(t, FENCE, -1), lambda s, i: F.when(
            (i % 2 == 1) & (s != ""), F.when(F.endswith(s, F.lit("\n")), s).otherwise(F.concat(s, F.lit("\n"))))),
            lambda s: s.isNotNull())
        return F.when(F.contains(t, F.lit("```")), text.let(F.array_join(inside, ""), lambda j: F.when(
            j != "", F.substring(j, 1, F.greatest(F.length(j) - 1, F.lit(0)))).otherwise(t))).otherwise(t)

    body = text.let(text.strip(response), unfence)
    return text.strip(F.regexp_replace(body, CUT, ""))


def apply_verdicts(findings: DataFrame, responses: DataFrame) -> DataFrame:
    """Set verdict and confidence from the answers; no finding is dropped. The explanation of a
    failed call tells the error."""
    error = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    r = responses.select("finding_id", "response", error.alias("_error"))
    joined = sized_join(findings.withColumn("finding_id", finding_id()), r, "finding_id", "left")
    upper = F.upper("response")
    yes = F.contains(upper, F.lit("CONFIRMED: YES"))
    no = F.contains(upper, F.lit("CONFIRMED: NO")) | F.contains(upper, F.lit("REJECTED"))
    confidence = (F.when(yes, F.least(F.lit(1.0), F.col("confidence") + CONFIRM_BOOST))
                  .when(no, F.greatest(F.lit(0.0), F.col("confidence") - REJECT_CUT))
                  .otherwise(F.col("confidence")))
    return joined.select(
        *[c for c in findings.columns if c != "confidence"], "finding_id", confidence.alias("confidence"),
        F.when(yes, True).when(no, False).alias("llm_confirmed"),
        F.when(F.col("response").isNotNull(), confidence).alias("llm_confidence"),
        F.coalesce("response", F.concat(F.lit("LLM unavailable: "), "_error"), F.lit("")).alias("llm_explanation"))
