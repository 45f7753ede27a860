"""Dimension data: rules, call signatures, weakness names, severities, fix functions.

Every table here is made on the driver from lists of the program, so joining it with
``broadcast`` never depends on the data size.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. These texts, numbers and patterns define the results and are
# stated as they are.
# ---------------------------------------------------------------------------

SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}

C_EXTENSIONS = [".c", ".h"]
CPP_EXTENSIONS = [".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".hh"]
ALL_EXTENSIONS = C_EXTENSIONS + CPP_EXTENSIONS
SKIP_DIRS = [
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", "build",
    "cmake-build-debug", "cmake-build-release", ".idea", ".vscode", "dist",
]

CWE_NAMES = {
    "CWE-78": "Improper Neutralization of Special Elements used in an OS Command (Command Injection)",
    "CWE-120": "Buffer Copy without Checking Size of Input (Classic Buffer Overflow)",
    "CWE-121": "Stack-based Buffer Overflow",
    "CWE-122": "Heap-based Buffer Overflow",
    "CWE-134": "Use of Externally-Controlled Format String",
    "CWE-190": "Integer Overflow or Wraparound",
    "CWE-242": "Use of Inherently Dangerous Function",
    "CWE-362": "Concurrent Execution using Shared Resource with Improper Synchronization (Race Condition)",
    "CWE-367": "Time-of-check Time-of-use (TOCTOU) Race Condition",
    "CWE-401": "Missing Release of Memory after Effective Lifetime (Memory Leak)",
    "CWE-415": "Double Free",
    "CWE-416": "Use After Free",
    "CWE-476": "NULL Pointer Dereference",
    "CWE-908": "Use of Uninitialized Resource",
}
CWE_ALIASES = {"CWE-242": "CWE-120", "CWE-121": "CWE-120", "CWE-122": "CWE-120"}
CWE_URL_PREFIX = "https://cwe.mitre.org/data/definitions/"

FUNCTION_KEYWORDS = ["if", "else", "for", "while", "switch", "do", "return", "sizeof", "typedef"]

TEMPLATE_FUNCTIONS = ["gets", "strcpy", "strcat", "sprintf", "vsprintf", "scanf", "wcscpy"]

DETECTOR_RANK = {"ast": 3, "tree-sitter": 3, "regex": 1}
RULE_CONFIDENCE = 0.6
SAME_SPOT_BOOST = 0.15
REPEAT_BOOST = 0.05


class Rule(NamedTuple):
    id: str
    name: str
    pattern: str
    cwe_id: str
    severity: str
    description: str
    recommendation: str
    needle: str = ""  # a literal every match contains; lets a scan skip the regex
    category: str = "user"
    languages: tuple[str, ...] = ("c", "cpp")


RULES: list[Rule] = [
    Rule("BOF-001", "gets() usage", r"\bgets\s*\(", "CWE-242", "critical",
         "gets() has no bounds checking — guaranteed buffer overflow",
         "Replace with fgets(buf, sizeof(buf), stdin)", "gets", "buffer_overflow"),
    Rule("BOF-002", "strcpy() without bounds", r"\bstrcpy\s*\(", "CWE-120", "high",
         "strcpy() copies without size limit",
         "Use strncpy() or strlcpy() with explicit size", "strcpy", "buffer_overflow"),
    Rule("BOF-003", "strcat() without bounds", r"\bstrcat\s*\(", "CWE-120", "high",
         "strcat() concatenates without size limit",
         "Use strncat() or strlcat() with explicit size", "strcat", "buffer_overflow"),
    Rule("BOF-004", "sprintf() without bounds", r"\bsprintf\s*\(", "CWE-120", "high",
         "sprintf() writes without size limit",
         "Use snprintf() with explicit buffer size", "sprintf", "buffer_overflow"),
    Rule("BOF-005", "scanf %s without width", r'\bscanf\s*\(\s*"[^"]*%s', "CWE-120", "high",
         "scanf with %s reads unbounded input",
         "Use %Ns with explicit width, e.g. %255s", "scanf", "buffer_overflow"),
    Rule("BOF-006", "vsprintf() without bounds", r"\bvsprintf\s*\(", "CWE-120", "high",
         "vsprintf() writes without size limit",
         "Use vsnprintf() with explicit buffer size", "vsprintf", "buffer_overflow"),
    Rule("BOF-007", "wcscpy() without bounds", r"\bwcscpy\s*\(", "CWE-120", "high",
         "wcscpy() copies wide strings without bounds",
         "Use wcsncpy() with explicit size", "wcscpy", "buffer_overflow"),
    Rule("FMT-001", "printf() with variable format", r"\bprintf\s*\(\s*[a-zA-Z_]\w*\s*\)",
         "CWE-134", "high", "printf() called with variable as format string",
         'Use printf("%s", variable) instead', "printf", "format_string"),
    Rule("FMT-002", "fprintf() with variable format",
         r"\bfprintf\s*\(\s*\w+\s*,\s*[a-zA-Z_]\w*\s*\)", "CWE-134", "high",
         "fprintf() with variable format string",
         'Use fprintf(stream, "%s", variable)', "fprintf", "format_string"),
    Rule("FMT-003", "syslog() with variable format",
         r"\bsyslog\s*\(\s*\w+\s*,\s*[a-zA-Z_]\w*\s*\)", "CWE-134", "high",
         "syslog() with variable format string",
         'Use syslog(priority, "%s", variable)', "syslog", "format_string"),
    Rule("CMD-001", "system() call", r"\bsystem\s*\(", "CWE-78", "critical",
         "system() executes shell commands — command injection risk",
         "Use exec family (execvp) with explicit argument arrays", "system", "command_injection"),
    Rule("CMD-002", "popen() call", r"\bpopen\s*\(", "CWE-78", "high",
         "popen() executes shell commands",
         "Use fork/exec with explicit argument arrays", "popen", "command_injection"),
    Rule("UAF-001", "free() without NULL assignment",
         r"\bfree\s*\(\s*(\w+)\s*\)\s*;(?!\s*\1\s*=\s*NULL)", "CWE-416", "high",
         "Pointer not set to NULL after free()",
         "Set pointer to NULL immediately after free()", "free", "use_after_free"),
    Rule("UAF-002", "Potential double free",
         r"\bfree\s*\(\s*(\w+)\s*\)[\s\S]{0,200}?\bfree\s*\(\s*\1\s*\)", "CWE-415", "critical",
         "Same pointer freed twice — heap corruption",
         "Set pointer to NULL after first free", "free", "use_after_free"),
    Rule("INT-001", "malloc with arithmetic", r"\bmalloc\s*\(\s*\w+\s*[*+]\s*\w+\s*\)",
         "CWE-190", "high", "Arithmetic in malloc size can integer-overflow",
         "Check for overflow before multiplication, or use calloc()", "malloc", "integer_overflow"),
    Rule("INT-002", "realloc with arithmetic",
         r"\brealloc\s*\(\s*\w+\s*,\s*\w+\s*[*+]\s*\w+\s*\)", "CWE-190", "high",
         "Arithmetic in realloc size can integer-overflow",
         "Validate new size before realloc", "realloc", "integer_overflow"),
    Rule("RACE-001", "TOCTOU: access() then open()",
         r"\baccess\s*\([^)]+\)[\s\S]{0,300}?\bopen\s*\(", "CWE-367", "medium",
         "Time-of-check / time-of-use race between access() and open()",
         "Use open() with appropriate flags instead", "access", "race_condition"),
    Rule("RACE-002", "TOCTOU: stat() then open()",
         r"\bstat\s*\([^)]+\)[\s\S]{0,300}?\bopen\s*\(", "CWE-367", "medium",
         "stat() + open() is a TOCTOU race condition",
         "Use fstat() after open() instead", "stat", "race_condition"),
    Rule("NULL-001", "malloc without NULL check",
         r"\b(\w+)\s*=\s*malloc\s*\([^)]+\)\s*;(?!\s*if\s*\(\s*\1)", "CWE-476", "medium",
         "malloc() return not checked for NULL",
         "Always check malloc() return value before use", "malloc", "null_deref"),
    Rule("NULL-002", "calloc without NULL check",
         r"\b(\w+)\s*=\s*calloc\s*\([^)]+\)\s*;(?!\s*if\s*\(\s*\1)", "CWE-476", "medium",
         "calloc() return not checked for NULL",
         "Always check calloc() return value before use", "calloc", "null_deref"),
    Rule("NULL-003", "realloc without NULL check",
         r"\b(\w+)\s*=\s*realloc\s*\([^)]+\)\s*;(?!\s*if\s*\(\s*\1)", "CWE-476", "medium",
         "realloc() return not checked for NULL",
         "Check realloc() return; assign to temp pointer first", "realloc", "null_deref"),
    Rule("LEAK-001", "malloc in loop without free",
         r"(for|while)\s*\([^)]*\)\s*\{[^}]*\bmalloc\s*\([^)]*\)(?![^}]*\bfree\s*\()",
         "CWE-401", "medium", "malloc() inside loop without matching free()",
         "Ensure every malloc inside a loop has a corresponding free", "malloc", "memory_leak"),
    Rule("UNINIT-001", "Uninitialized stack buffer", r"\bchar\s+\w+\s*\[\s*\d+\s*\]\s*;",
         "CWE-908", "low", "Stack char buffer declared without initialisation — may leak data",
         "Initialise with = {0} or memset()", "char", "uninitialized"),
    Rule("MEM-001", "memcpy with variable size",
         r"\bmemcpy\s*\(\s*\w+\s*,\s*\w+\s*,\s*[a-zA-Z_]\w*\s*\)", "CWE-120", "medium",
         "memcpy() with variable size — verify bounds",
         "Validate size parameter against destination buffer", "memcpy", "unsafe_memory"),
    Rule("MEM-002", "memmove with variable size",
         r"\bmemmove\s*\(\s*\w+\s*,\s*\w+\s*,\s*[a-zA-Z_]\w*\s*\)", "CWE-120", "medium",
         "memmove() with variable size — verify bounds",
         "Validate size parameter against destination buffer", "memmove", "unsafe_memory"),
]

# function -> (cwe, severity, description, recommendation), C++ files
CPP_COPY = {
    "gets": ("CWE-242", "critical", "gets() has no bounds checking",
             "Replace with fgets(buf, sizeof(buf), stdin)"),
    "strcpy": ("CWE-120", "high", "strcpy() copies without size limit",
               "Use strncpy() or strlcpy() with explicit size"),
    "strcat": ("CWE-120", "high", "strcat() concatenates without size limit",
               "Use strncat() or strlcat() with explicit size"),
    "sprintf": ("CWE-120", "high", "sprintf() writes without size limit",
                "Use snprintf() with explicit buffer size"),
    "vsprintf": ("CWE-120", "high", "vsprintf() writes without size limit",
                 "Use vsnprintf() with explicit buffer size"),
    "wcscpy": ("CWE-120", "high", "wcscpy() copies wide strings without bounds",
               "Use wcsncpy() with explicit size"),
}
CPP_EXEC = {
    "system": ("CWE-78", "critical", "system() executes shell commands",
               "Use exec family (execvp) with explicit args"),
    "popen": ("CWE-78", "high", "popen() executes shell commands",
              "Use fork/exec with explicit argument arrays"),
}
C_COPY = ["strcpy", "strcat", "sprintf", "gets", "vsprintf", "wcscpy"]
C_EXEC = ["system", "popen"]
C_INPUT = ["scanf", "sscanf"]
FORMAT_FUNCTIONS = ["printf", "fprintf", "syslog"]
ALLOC_FUNCTIONS = ["malloc", "calloc", "realloc"]

# ---------------------------------------------------------------------------
# Tables built from the values above.
# ---------------------------------------------------------------------------

REPORT_RANK = {k: 4 - v for k, v in SEVERITY_RANK.items()}


class Signature(NamedTuple):
    detector: str
    language: str
    family: str
    function_name: str
    fmt_arg: int  # argument holding a format string, -1 where none
    rule_id: str
    cwe_id: str
    severity: str
    confidence: float
    vuln_type: str
    description: str
    recommendation: str


def _fmt_arg(fn: str) -> int:
    return 1 if fn == "fprintf" else 0


def _signatures() -> list[Signature]:
    out: list[Signature] = []

    def c(fn, family, tag, cwe, sev, what, desc, rec, fmt=-1):
        out.append(Signature("ast", "c", family, fn, fmt, f"AST-{tag}-{fn}", cwe, sev, 0.8,
                             f"{what}_{fn}()", desc, rec))

    def cpp(fn, family, tag, cwe, sev, conf, what, desc, rec, fmt=-1):
        out.append(Signature("tree-sitter", "cpp", family, fn, fmt, f"TS-{tag}-{fn}", cwe, sev,
                             conf, f"{what}_{fn}()", desc, rec))

    for fn in C_COPY:
        c(fn, "copy", "BOF", "CWE-120", "high", "unsafe", f"{fn}() is an unsafe copy function",
          f"Replace {fn}() with bounds-checked alternative")
    for fn in C_EXEC:
        c(fn, "exec", "CMD", "CWE-78", "critical", "command_exec",
          f"{fn}() executes shell commands", "Use exec family with explicit args")
    for fn in FORMAT_FUNCTIONS:
        c(fn, "format", "FMT", "CWE-134", "high", "format_string",
          f"{fn}() with non-literal format string", f'Use {fn}("%s", var) instead', _fmt_arg(fn))
    for fn in C_INPUT:
        c(fn, "input", "INP", "CWE-120", "high", "unsafe_input",
          f"{fn}() can read unbounded input", "Validate/limit input size")
    for fn in ALLOC_FUNCTIONS:
        c(fn, "alloc", "NULL", "CWE-476", "medium", "unchecked",
          f"{fn}() return value may not be NULL-checked",
          f"Always check {fn}() return for NULL")

    for fn, (cwe, sev, desc, rec) in CPP_COPY.items():
        cpp(fn, "copy", "BOF", cwe, sev, 0.85, "unsafe", desc, rec)
    for fn, (cwe, sev, desc, rec) in CPP_EXEC.items():
        cpp(fn, "exec", "CMD", cwe, sev, 0.85, "command_exec", desc, rec)
    for fn in FORMAT_FUNCTIONS:
        cpp(fn, "format", "FMT", "CWE-134", "high", 0.8, "format_string",
            f"{fn}() with non-literal format string", f'Use {fn}("%s", var) instead', _fmt_arg(fn))
    for fn in ALLOC_FUNCTIONS:
        cpp(fn, "alloc", "NULL", "CWE-476", "medium", 0.7, "unchecked",
            f"{fn}() return value may not be NULL-checked",
            f"Always check {fn}() return for NULL")
    out.append(Signature("tree-sitter", "cpp", "new", "new", -1, "TS-CPP-NEW", "CWE-476", "medium",
                         0.6, "unchecked_new", "new without nothrow may throw on allocation failure",
                         "Use std::nothrow or wrap in try/catch"))
    out.append(Signature("tree-sitter", "cpp", "delete", "delete", -1, "TS-CPP-DEL", "CWE-416",
                         "medium", 0.6, "delete_without_nullptr",
                         "Pointer not set to nullptr after delete",
                         "Set pointer to nullptr after delete"))
    return out


SIGNATURES = _signatures()


def canonical_cwe(cwe_id: str) -> str:
    return CWE_ALIASES.get(cwe_id, cwe_id)


def type_key(vuln_type: str) -> str:
    """Key of a finding that names no function: first word of its type."""
    m = re.search(r"\w+", vuln_type)
    return m.group(0).lower() if m else ""


def java_dialect(pattern: str) -> str:
    """A pattern in the rules' dialect for the engine that runs it: group names and the end of
    the text are written in another way there."""
    plain = lambda m: m.group(1).replace("_", "") + "x" * m.group(1).count("_")
    pattern = re.sub(r"(?<!\\)\(\?P<(\w+)>", lambda m: f"(?<{plain(m)}>", pattern)
    pattern = re.sub(r"(?<!\\)\(\?P=(\w+)\)", lambda m: f"\\k<{plain(m)}>", pattern)
    return re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", pattern)


def usable_rules(rules: Iterable[Rule]) -> list[Rule]:
    """Drop rules whose pattern compiles in neither or only one of the two dialects, as a scan
    skips them, with a warning that names them."""
    spark = SparkSession.getActiveSession()
    kept = []
    for r in rules:
        try:
            re.compile(r.pattern)
            if spark is not None and r not in RULES:
                spark._jvm.java.util.regex.Pattern.compile("(?dU)" + java_dialect(r.pattern))
        except (re.error, IllegalArgumentException) as problem:
            warnings.warn(f"rule {r.id} is left out: {str(problem).splitlines()[0]}", stacklevel=2)
            continue
        kept.append(r)
    return kept


def _rows_literal(rows: Sequence[dict], schema: str) -> Column:
    """Rows as an array of structs that folds to one literal."""
    return F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{schema}>>")


def table(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """A small fixed table as one folded literal; it plans as a local relation."""
    return spark.range(0, 1, 1, 1).select(F.inline(_rows_literal(rows, schema)))


class Detector(NamedTuple):
    """A user's own detector. ``hits`` takes the columns of a file's text and language and gives its
    findings in order, as array<struct<line int, rule int, function_name string>>; ``rule`` is a
    place in ``rules``. Names other than the built-in ones rank below them in merging."""

    name: str
    rules: Sequence[Rule]
    hits: Callable[[Column, Column], Column]
    confidence: float = RULE_CONFIDENCE


FINDING_DIM = ("dim_idx:bigint,rule_id:string,vuln_type:string,cwe_id:string,severity:string,"
               "confidence:double,description:string,recommendation:string,detector:string,"
               "category:string,canon_cwe:string,type_key:string")


def finding_rows(rules: Sequence[Rule] = tuple(RULES), detectors: Sequence[Detector] = ()) -> list[dict]:
    """One row per rule and per signature, and per rule of further detectors, keyed by the index
    that a finding carries."""
    of_rule = lambda r, detector, confidence: dict(
        rule_id=r.id, vuln_type=r.name, cwe_id=r.cwe_id, severity=r.severity, confidence=confidence,
        description=r.description, recommendation=r.recommendation, detector=detector, category=r.category)
    rows = [of_rule(r, "regex", RULE_CONFIDENCE) for r in rules]
    rows += [dict(rule_id=s.rule_id, vuln_type=s.vuln_type, cwe_id=s.cwe_id, severity=s.severity, confidence=s.confidence,
                  description=s.description, recommendation=s.recommendation, detector=s.detector, category=s.family)
             for s in SIGNATURES]
    rows += [of_rule(r, d.name, d.confidence) for d in detectors for r in d.rules]
    return [dict(row, dim_idx=i, canon_cwe=canonical_cwe(row["cwe_id"]), type_key=type_key(row["vuln_type"])) for i, row in enumerate(rows)]


def finding_dim(spark: SparkSession, rules: Sequence[Rule] = tuple(RULES), detectors: Sequence[Detector] = ()) -> DataFrame:
    return table(spark, finding_rows(rules, detectors), FINDING_DIM)


def named(cwe_id: str, description: str) -> str:
    """The weakness name in front of the description unless it is there already."""
    name = CWE_NAMES.get(cwe_id)
    return description if name is None or description is None or name in description else f"[{cwe_id}] {name} — {description}"


def finding_literal(rules: Sequence[Rule] = tuple(RULES), detectors: Sequence[Detector] = ()) -> Column:
    """``finding_dim`` as an array in the order of ``dim_idx``, with the description that begins with
    the weakness name, the detector's rank and the severity's ranks, for lookups inside a row."""
    rows = [dict(row, named=named(row["cwe_id"], row["description"]), rank=DETECTOR_RANK.get(row["detector"], 0),
                 severity_rank=SEVERITY_RANK.get(row["severity"], 0), report_rank=REPORT_RANK.get(row["severity"], 9))
            for row in finding_rows(rules, detectors)]
    return _rows_literal(rows, FINDING_DIM + ",named:string,rank:int,severity_rank:int,report_rank:int")


def rule_dim(spark: SparkSession, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    rows = [dict(rule_ord=i, id=r.id, name=r.name, pattern=r.pattern, cwe_id=r.cwe_id,
                 severity=r.severity, description=r.description,
                 recommendation=r.recommendation, category=r.category,
                 languages=list(r.languages)) for i, r in enumerate(rules)]
    return table(spark, rows, (
        "rule_ord:bigint,id:string,name:string,pattern:string,cwe_id:string,severity:string,"
        "description:string,recommendation:string,category:string,languages:array<string>"))


def signature_dim(spark: SparkSession, base: int = len(RULES)) -> DataFrame:
    rows = [dict(s._asdict(), dim_idx=base + j) for j, s in enumerate(SIGNATURES)]
    return table(spark, rows, (
        "dim_idx:bigint,detector:string,language:string,family:string,function_name:string,"
        "fmt_arg:int,rule_id:string,cwe_id:string,severity:string,confidence:double,"
        "vuln_type:string,description:string,recommendation:string"))


def cwe_dim(spark: SparkSession) -> DataFrame:
    return table(spark, [dict(cwe_id=k, cwe_name=v) for k, v in CWE_NAMES.items()],
                 "cwe_id:string,cwe_name:string")
