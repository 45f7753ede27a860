"""Every operator as a named query over the given tables, beside its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, scalars, text
from ..operators import analyze, assist, calls, detect, merge, patch, report
from ..session import checkpoint_folder, materialized
from ..sources import files as src
from ..sources import sinks
from ..streaming.scan_stream import scan_stream
from . import corpus
from .oracle_base import CTES, HEAD_RE2, REPORT_RANK, SEVERITY_RANK, hits_of, lit, newlines, q, rewrite

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(key: str, run: Query, sql: str | None = None, **extra: str) -> None:
    QUERIES[key] = run
    if sql is not None:
        ORACLES[key] = q(sql, **extra)


def code(s: SparkSession, d: str) -> DataFrame:
    return corpus.code_files(s, d).select("file_path", "language", "code")


def all_files(s: SparkSession, d: str) -> DataFrame:
    return code(s, d).unionByName(corpus.text_files(s, d))


def found(s: SparkSession, d: str, minimum: str = "low") -> DataFrame:
    return merge.scan(code(s, d), minimum)


def scanned(s: SparkSession, d: str) -> DataFrame:
    """The files, each with its findings."""
    return merge.scan_files(code(s, d))


def slim(s: SparkSession, d: str, *fields: str, minimum: str = "low") -> DataFrame:
    """``scanned`` for queries that ask for few fields of a finding."""
    return merge.scan_files(code(s, d), minimum, fields=fields)


def big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


FINDING = ["file_path", "line", "vuln_type", "rule_id", "cwe_id", "severity", "confidence",
           "description", "recommendation", "detector", "function_name"]
FINDING_SQL = ", ".join("line::BIGINT AS line" if c == "line" else c for c in FINDING)


def shown(df: DataFrame, *columns: str) -> DataFrame:
    names = columns or FINDING
    return df.select(*[F.col(c).cast("bigint").alias(c) if c == "line" else F.col(c) for c in names])


# ------------------------------------------------------------------ sources and sinks
ROOT = "/build/root"
EXT_LIST = ", ".join(lit(e) for e in dims.ALL_EXTENSIONS)
SKIP_LIST = ", ".join(lit(e) for e in dims.SKIP_DIRS)


def _pick(v, key):
    return "[" + ", ".join(lit(x) for x in v) + f"][({key}) % {len(v)} + 1]"


PATHS_SQL = f"""SELECT '/build/root/proj' || (c % 25) || '/' || {_pick(corpus.DIRECTORIES, 'o')} || '/f' || o
  || {_pick(corpus.EXTENSIONS, 'o + c')} AS path, o FROM (SELECT o_orderkey AS o, o_custkey AS c FROM orders)"""
EXT_SQL = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"

FILES_AT_ONCE = 500_000  # of a tree on disk, where even a small file takes a block


def _listed(s, d):
    """The candidates as files of real folders, and what the source lists there. All are written and
    listed, some at a time: a tree that is listed is removed before the next one is written."""
    base = f"{checkpoint_folder(s).rstrip('/')}/tree-{uuid.uuid4().hex}"
    paths = corpus.path_candidates(s, d)
    trees = paths.count() // FILES_AT_ONCE + 1
    for k in range(trees):
        root, part = f"{base}/{k}", paths.where(F.pmod(F.xxhash64("path"), F.lit(trees)) == k)
        corpus.write_tree(part, root + ROOT)
        listed = src.list_files(s, root + ROOT)
        name = F.concat(F.lit(ROOT), F.substring_index("path", f"/{k}{ROOT}", -1))
        listed.select(name.alias("path")).write.mode("append").parquet(f"{base}/listed")
        corpus.remove_tree(part, root + ROOT)
    return s.read.parquet(f"{base}/listed")


add("src_files", _listed,
    f"SELECT path FROM paths WHERE {EXT_SQL} IN ({EXT_LIST}) AND NOT list_has_any("
    f"string_split(substr(path, {len(ROOT) + 1}), '/')[1:-2], [{SKIP_LIST}])", paths=PATHS_SQL)
add("src_decode",
    lambda s, d: corpus.path_candidates(s, d).select("path", src.decode(F.concat(
        F.encode("code", "UTF-8"), F.unhex(F.lit("FFC3A9E28241EFBFBD80")))).alias("code")),
    "SELECT path, 'a' || o || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'éA' || chr(65533) AS code FROM paths",
    paths=PATHS_SQL)
add("src_language",
    lambda s, d: corpus.path_candidates(s, d).select(
        "path", src.language_of(F.col("path")).alias("language"), src.is_c_file(F.col("path")).alias("is_c")),
    f"SELECT path, CASE WHEN {EXT_SQL} IN ('.c', '.h') THEN 'c' ELSE 'cpp' END AS language, "
    f"{EXT_SQL} IN ('.c', '.h') AS is_c FROM paths", paths=PATHS_SQL)
add("src_table",
    lambda s, d: src.from_table(corpus.load(s, d, "documents").select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".H")).alias("path"), "text"),
        "path", "text"),
    "SELECT source || '/' || doc_id || '.H' AS file_path, 'c' AS language, "
    "regexp_replace(text, '\\r\\n?', chr(10), 'g') AS code FROM documents")
def _page_texts(s, d):
    """The document each page shows, as far as there is one: file_path, code."""
    shown_doc = F.regexp_extract("url", r"/([0-9]{1,18})[^/]*$", 1).try_cast("bigint")
    pages = corpus.load(s, d, "pages").select("page_id", shown_doc.alias("doc_id"))
    texts = corpus.load(s, d, "documents").select("doc_id", F.col("text").alias("code"))
    return pages.join(texts, "doc_id", "left").select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string")).alias("file_path"), "code")


add("src_errors", lambda s, d: src.errors(_page_texts(s, d)),
    """SELECT '/pages/' || page_id AS file_path, '/pages/' || page_id || ': no text' AS error FROM pages
       LEFT JOIN documents ON doc_id = try_cast(regexp_extract(url, '/([0-9]{1,18})[^/]*$', 1) AS BIGINT) WHERE text IS NULL""")
add("dim_rules", lambda s, d: analyze.rule_usage(detect.scan_rules(code(s, d))),
    """SELECT id, name, pattern, cwe_id, severity, description, recommendation,
         replace(languages, ',', ', ') AS languages, coalesce(n, 0)::BIGINT AS hits
       FROM rules LEFT JOIN (SELECT dim_idx, count(*) AS n FROM rule_hits GROUP BY 1) h ON h.dim_idx = rule_ord""")
add("sink_json", lambda s, d: sinks.finding_json(shown(found(s, d))),
    f"""SELECT file_path, to_json({{'file_path': file_path, 'line': line, 'column': 0, 'vuln_type': vuln_type,
         'rule_id': rule_id, 'cwe_id': cwe_id, 'severity': severity, 'confidence': confidence,
         'description': description, 'recommendation': recommendation, 'snippet': '', 'detector': detector,
         'function_name': function_name, 'llm_confirmed': NULL, 'llm_confidence': NULL,
         'llm_explanation': '', 'llm_fix': ''}})::VARCHAR AS json FROM findings""")

NUMBERED = f"SELECT *, row_number() OVER (ORDER BY {REPORT_RANK}, file_path, line, seq) AS number FROM findings"
ESC = ("replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
       "'\"', '&quot;'), '''', '&#x27;')")
BASE = "regexp_extract(file_path, '[^/]*$')"
ROWS_SQL = f"""SELECT number::BIGINT AS number, upper(severity) AS severity, rule_id, cwe_id, {BASE} AS file_name,
  line::BIGINT AS line, {ESC.format('vuln_type')} AS vuln_type,
  {ESC.format('recommendation')} AS recommendation, detector FROM num"""
add("report_rows", lambda s, d: report.rows(found(s, d)), ROWS_SQL, num=NUMBERED)
add("report_detail", lambda s, d: report.details(found(s, d)),
    """SELECT number::BIGINT AS number, '#' || number || ' [' || upper(severity) || ']' AS title,
         vuln_type || chr(10) || 'File: ' || file_path || ':' || line || chr(10) || 'CWE:  ' || cwe_id || chr(10)
         || 'Desc: ' || description || chr(10) || 'Fix:  ' || recommendation || chr(10) AS block FROM num""",
    num=NUMBERED)
add("enumerate", lambda s, d: report.enumerate_findings(found(s, d)).select(
        "number", "file_path", *big("line"), "rule_id", "function_name"),
    "SELECT number::BIGINT AS number, file_path, line::BIGINT AS line, rule_id, function_name FROM num", num=NUMBERED)
add("search_report", lambda s, d: report.search_rows(report.rows(found(s, d)), "CWE-12", "high"),
    f"""SELECT * FROM (SELECT {ROWS_SQL.split('SELECT', 1)[1]}) WHERE lower(severity) = 'high' AND contains(
      lower(number || severity || rule_id || cwe_id || file_name || line || vuln_type || recommendation || detector),
      'cwe-12')""", num=NUMBERED)

# ------------------------------------------------------------------ text functions
T = "FROM all_files"
STRIP = "regexp_replace(regexp_replace(code, '//[^\\n]*', '', 'g'), '/\\*[\\s\\S]*?\\*/', '', 'g')"
WS = text.SPACE
WS_LINE = WS.replace(r"\n", "")
STRIP_PP = "regexp_replace(@t, '(?m)^\\s*#[^\\n]*', '', 'g')"
RSTRIP = "regexp_replace(@t, '(?m)[" + WS_LINE + "]+$', '', 'g')"


def over_all(expr: Callable, name: str = "result") -> Query:
    return lambda s, d: all_files(s, d).select("file_path", expr(F.col("code")).alias(name))


add("txt_strip_comments", over_all(text.strip_comments), f"SELECT file_path, {STRIP} AS result {T}")
add("txt_neutralize", over_all(text.neutralize), "SELECT file_path, neut AS result FROM t_neutral", **{
    "t_neutral1": CTES["neutral1"].replace("code_files", "all_files"),
    "t_neutral2": CTES["neutral2"].replace("neutral1", "t_neutral1"),
    "t_neutral3": CTES["neutral3"].replace("neutral2", "t_neutral2"),
    "t_neutral": CTES["neutral"].replace("neutral3", "t_neutral3")})
add("txt_strip_pp", over_all(text.strip_preprocessor), f"SELECT file_path, {STRIP_PP.replace('@t', 'code')} AS result {T}")
add("txt_preprocess", over_all(lambda c: text.preprocess(c, True, True)),
    f"SELECT file_path, {RSTRIP.replace('@t', STRIP_PP.replace('@t', STRIP))} AS result {T}")
add("txt_clean_parser", over_all(text.clean_for_calls),
    "SELECT file_path, regexp_replace(regexp_replace(" + rewrite(
        "code", r"/\*[\s\S]*?\*/", "regexp_replace(@m, '[^\\n]', '', 'g')")
    + ", '//[^\\n]*', '', 'g'), '(?m)^[^\\S\\n]*#[^\\n]*', '', 'g') AS result FROM all_files")

LINES = "string_split(code, chr(10))"
AT = "1 + length(code) % len(ls)"


def _at(s, d):
    return all_files(s, d).withColumn("line", (F.length("code") % F.size(text.lines_of(F.col("code"))) + 1).cast("int"))


LINED = f"SELECT *, ({AT})::BIGINT AS line FROM (SELECT file_path, code, {LINES} AS ls FROM all_files)"
SLICE = "ls[greatest(0, line - 6) + 1 : least(len(ls), line + 5)]"
add("txt_raw_snippet", lambda s, d: _at(s, d).select(
        "file_path", *big("line"), text.raw_snippet(F.col("code"), F.col("line")).alias("result")),
    f"SELECT file_path, line, array_to_string({SLICE}, chr(10)) AS result FROM lined", lined=LINED)
add("txt_snippet", lambda s, d: _at(s, d).select(
        "file_path", text.snippet(F.col("code"), F.col("line")).alias("p")).select(
        "file_path", F.col("p.text").alias("result"), F.col("p.start_line").cast("bigint").alias("start_line"),
        F.col("p.end_line").cast("bigint").alias("end_line")),
    f"""SELECT file_path, array_to_string(list_transform({SLICE}, lambda x, i:
         format('{{:4d}} | ', i + greatest(0, line - 6)) || x), chr(10)) AS result,
         (greatest(0, line - 6) + 1)::BIGINT AS start_line, least(len(ls), line + 5)::BIGINT AS end_line FROM lined""",
    lined=LINED)
INCLUDES = "regexp_extract_all(code, '#include\\s*[<\"]([^>\"]+)[>\"]', 1)"
FUNCTIONS = (f"list_filter(regexp_extract_all({STRIP}, '\\b(\\w+)\\s*\\([^)]*\\)\\s*\\{{', 1), lambda x: x NOT IN ("
             + ", ".join(lit(k) for k in dims.FUNCTION_KEYWORDS) + "))")
TOTAL_LINES = f"({newlines('code')} + 1)"
CODE_LINES = f"len(list_filter(string_split({STRIP}, chr(10)), lambda x: regexp_matches(x, '[^{WS}]')))"
add("txt_includes", over_all(lambda c: F.array_join(text.includes(c), ",")),
    f"SELECT file_path, array_to_string({INCLUDES}, ',') AS result {T}")
add("txt_functions", over_all(lambda c: F.array_join(text.functions(c), ",")),
    f"SELECT file_path, array_to_string({FUNCTIONS}, ',') AS result {T}")
META_SQL = (f"SELECT file_path AS path, {TOTAL_LINES}::BIGINT AS total_lines, {CODE_LINES}::BIGINT AS code_lines, "
            f"language, array_to_string({INCLUDES}, ',') AS includes, array_to_string({FUNCTIONS}, ',') AS functions ")
add("file_metadata", lambda s, d: analyze.file_metadata(all_files(s, d)).withColumns(
        {"includes": F.array_join("includes", ","), "functions": F.array_join("functions", ",")}), META_SQL + T)
add("txt_line_of", lambda s, d: code(s, d).select("file_path", F.posexplode(text.hit_lines(
        text.unmark(text.neutralize(F.col("code"))), r"\bgets\s*\(")).alias("k", "line")).select(
        "file_path", (F.col("k") + 1).cast("bigint").alias("k"), *big("line")),
    "SELECT file_path, k::BIGINT AS k, line::BIGINT AS line FROM rule_hits WHERE dim_idx = 0")
add("txt_match_fn", lambda s, d: detect.scan_rules(code(s, d)).groupBy("rule_id", "function_name").agg(
        F.count("*").alias("n")),
    "SELECT rule_id, function_name, count(*) AS n FROM rule_hits JOIN finding_dim USING (dim_idx) GROUP BY ALL")
add("txt_basename", lambda s, d: all_files(s, d).select(
        "file_path", text.basename(F.replace("file_path", F.lit("/pages/"), F.lit("C:\\pages\\"))).alias("name"),
        text.truncate(F.col("code"), 80).alias("short"),
        text.escape_html(F.col("code"), quotes=False).alias("escaped")),
    f"""SELECT file_path, {BASE} AS name, CASE WHEN length(code) > 80 THEN substr(code, 1, 80) || '...' ELSE code END
         AS short, replace(replace(replace(code, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped {T}""")

# ------------------------------------------------------------------ scalar lookups
add("sev_order", lambda s, d: found(s, d).select(
        "file_path", "rule_id", "function_name", "severity",
        scalars.severity_rank(F.col("severity")).cast("bigint").alias("rank"),
        scalars.report_rank(F.col("severity")).cast("bigint").alias("report_rank")),
    f"SELECT file_path, rule_id, function_name, severity, ({SEVERITY_RANK})::BIGINT AS rank, "
    f"({REPORT_RANK})::BIGINT AS report_rank FROM findings")
add("conf_band", lambda s, d: report.list_view(found(s, d)).withColumn("line", F.col("line").cast("bigint")),
    f"""SELECT file_path, {BASE} AS file_name, line::BIGINT AS line, rule_id, p AS confidence_pct,
         CASE WHEN p >= 80 THEN 'high' WHEN p >= 60 THEN 'med-high' WHEN p >= 40 THEN 'med' ELSE 'low' END AS band,
         CASE WHEN length(description) > 80 THEN substr(description, 1, 80) || '...' ELSE description END
           AS short_description
       FROM (SELECT *, floor(confidence * 100 + 0.5::DOUBLE)::BIGINT AS p FROM findings)""")
add("cwe_url", lambda s, d: found(s, d).groupBy("cwe_id").agg(F.count("*").alias("n")).select(
        "cwe_id", "n", scalars.cwe_url(F.col("cwe_id")).alias("url"), scalars.cwe_name(F.col("cwe_id")).alias("name")),
    """SELECT f.cwe_id, count(*) AS n, 'https://cwe.mitre.org/data/definitions/' || replace(f.cwe_id, 'CWE-', '')
         || '.html' AS url, coalesce(any_value(c.cwe_name), f.cwe_id) AS name
       FROM findings f LEFT JOIN cwe_dim c ON c.cwe_id = f.cwe_id GROUP BY f.cwe_id""")
add("cwe_canonical", lambda s, d: merge.detect_all(code(s, d)).groupBy("cwe_id").agg(F.count("*").alias("n")).select(
        "cwe_id", scalars.canonical_cwe(F.col("cwe_id")).alias("canonical"), "n"),
    "SELECT d.cwe_id, d.canon_cwe AS canonical, count(*) AS n FROM raw_findings r JOIN finding_dim d "
    "ON d.dim_idx = r.dim_idx GROUP BY ALL")
add("fn_key", lambda s, d: merge.detect_all(code(s, d)).groupBy(
        scalars.function_key(F.col("function_name"), F.col("vuln_type")).alias("fn_key")).agg(F.count("*").alias("n")),
    "SELECT fn_key, count(*) AS n FROM raw_findings GROUP BY fn_key")
add("det_rank", lambda s, d: found(s, d).groupBy("detector").agg(F.count("*").alias("n")).select(
        "detector", scalars.detector_rank(F.col("detector")).cast("bigint").alias("rank"), "n"),
    "SELECT detector, CASE detector WHEN 'ast' THEN 3 WHEN 'tree-sitter' THEN 3 WHEN 'regex' THEN 1 ELSE 0 END::BIGINT "
    "AS rank, count(*) AS n FROM findings GROUP BY detector")

# ------------------------------------------------------------------ rule scan
RAW_COLUMNS = ["file_path", "language", "line", "rule_id", "cwe_id", "severity", "confidence", "detector",
               "function_name"]
RULE_SQL = ("SELECT h.file_path, h.language, h.line::BIGINT AS line, d.rule_id, d.cwe_id, d.severity, d.confidence, "
            "d.detector, h.function_name FROM rule_hits h JOIN finding_dim d ON d.dim_idx = h.dim_idx")
add("scan_rules", lambda s, d: shown(detect.scan_rules(code(s, d)), *RAW_COLUMNS), RULE_SQL)


def _one_rule(rule):
    return lambda s, d: shown(detect.scan_rules(code(s, d), [rule]), *RAW_COLUMNS)


for _i, _r in enumerate(dims.RULES):
    _part = CTES["rule_hits"].split(" UNION ALL ")[_i]
    add(f"rule_{_r.id}", _one_rule(_r), RULE_SQL.replace("rule_hits", "one_rule"), one_rule=_part)

_CPP_ONLY = [r._replace(languages=("cpp",)) for r in dims.RULES[:3]] + list(dims.RULES[3:])
add("scan_lang_gate", lambda s, d: shown(detect.scan_rules(code(s, d), _CPP_ONLY), *RAW_COLUMNS),
    RULE_SQL + " WHERE h.dim_idx >= 3 OR h.language = 'cpp'")
_USER_PACK = [
    dims.Rule("USR-001", "broken", r"(unclosed", "CWE-1", "low", "never used", ""),
    dims.Rule("USR-002", "script element", r"<script[^>]*>", "CWE-79", "high", "inline script", "Avoid it", "<script"),
    dims.Rule("USR-004", "conditional", r"(<)?a(?(1)>|b)", "CWE-1", "low", "runs in one dialect only", ""),
    dims.Rule("USR-005", "named group", r"<(?P<the_tag>td|li)>", "CWE-2", "low", "cell or item", ""),
    dims.Rule("USR-003", "linked page", r"href=", "CWE-601", "info", "link", "Check it"),
]
add("scan_bad_rule", lambda s, d: detect.scan_rules(corpus.text_files(s, d), _USER_PACK).groupBy(
        "file_path", "rule_id", "severity").agg(F.count("*").alias("n")),
    "SELECT file_path, 'USR-002' AS rule_id, 'high' AS severity, count(*) AS n FROM ("
    + hits_of("t_neutral", "neut", r"<script[^>]*>") + ") GROUP BY ALL UNION ALL "
    "SELECT file_path, 'USR-003' AS rule_id, 'info' AS severity, count(*) AS n FROM ("
    + hits_of("t_neutral", "neut", r"href=") + ") GROUP BY ALL UNION ALL "
    "SELECT file_path, 'USR-005' AS rule_id, 'low' AS severity, count(*) AS n FROM ("
    + hits_of("t_neutral", "neut", r"<(?:td|li)>") + ") GROUP BY ALL", **{
    "t_neutral1": CTES["neutral1"].replace("code_files", "text_files"),
    "t_neutral2": CTES["neutral2"].replace("neutral1", "t_neutral1"),
    "t_neutral3": CTES["neutral3"].replace("neutral2", "t_neutral2"),
    "t_neutral": CTES["neutral"].replace("neutral3", "t_neutral3")})

# ------------------------------------------------------------------ call sites
ALL_HEADS = HEAD_RE2.replace("|".join(sorted({x.function_name for x in dims.SIGNATURES} - {"new", "delete"})),
                             r"[A-Za-z_]\w*")
NOT_CALLS_SQL = ", ".join(lit(k) for k in calls.NOT_CALLS.split("|"))
DECLARED_SQL = ("name NOT IN ('new', 'delete') AND regexp_matches(prefix, '^\\s*(?:[A-Za-z_]\\w*[\\s*&]+)+$') "
                "AND NOT regexp_matches(prefix, '" + calls.LEADS_EXPRESSION + "')")
add("call_sites", lambda s, d: calls.call_sites(code(s, d)).select(
        "file_path", "language", *big("line"), "function_name", "receiver", F.array_join("args", "|").alias("args")),
    f"""SELECT file_path, language, line::BIGINT AS line, name AS function_name, receiver,
         array_to_string(list_transform(string_split(regexp_replace(
             regexp_extract(rest, '^((?:[^()]|\\([^()]*\\))*)\\)', 1),
             '\\(([^(),]*),([^()]*)\\)', '(\\1' || chr(7) || '\\2)', 'g'), ','),
           lambda a: trim(replace(a, chr(7), ','))), '|') AS args
       FROM every_call WHERE name NOT IN ({NOT_CALLS_SQL}) AND NOT ({DECLARED_SQL})""",
    every_call=CTES["call_hits"].replace(lit(HEAD_RE2), lit(ALL_HEADS)))
CALL_COLUMNS = ["file_path", "language", "line", "function_name", "rule_id", "cwe_id", "severity", "confidence"]
CALL_SQL = ("SELECT m.file_path, m.language, m.line::BIGINT AS line, m.name AS function_name, d.rule_id, d.cwe_id, "
            "d.severity, d.confidence FROM matched_calls m JOIN finding_dim d ON d.dim_idx = m.dim_idx")
add("call_join", lambda s, d: shown(calls.matched_calls(code(s, d)), *CALL_COLUMNS), CALL_SQL)


def _family(language, family):
    return lambda s, d: shown(calls.matched_calls(
        code(s, d).where(F.col("language") == language), [family]), *CALL_COLUMNS)


for _key, _lang, _fam in [
        ("c_unsafe_copy", "c", "copy"), ("c_exec", "c", "exec"), ("c_format", "c", "format"),
        ("c_input", "c", "input"), ("c_alloc", "c", "alloc"), ("cpp_unsafe_copy", "cpp", "copy"),
        ("cpp_exec", "cpp", "exec"), ("cpp_format", "cpp", "format"), ("cpp_alloc", "cpp", "alloc"),
        ("cpp_new", "cpp", "new"), ("cpp_delete", "cpp", "delete")]:
    add(_key, _family(_lang, _fam), CALL_SQL + f" WHERE m.language = '{_lang}' AND m.family = '{_fam}'")
add("call_receiver", lambda s, d: calls.call_sites(code(s, d)).where("receiver <> ''").select(
        "file_path", *big("line"), "function_name", "receiver", calls.is_member_call(F.col("language"), F.col("receiver")).alias("is_member")),
    f"""SELECT file_path, line::BIGINT AS line, name AS function_name, receiver,
         CASE WHEN language = 'c' THEN regexp_matches(receiver, '(?:\\.|->)$')
              ELSE regexp_matches(receiver, '^\\w+(?:\\.|->)$') AND NOT regexp_matches(receiver, '^this\\b') END AS is_member
       FROM every_call WHERE receiver <> '' AND name NOT IN ({NOT_CALLS_SQL}) AND NOT ({DECLARED_SQL})""",
    every_call=CTES["call_hits"].replace(lit(HEAD_RE2), lit(ALL_HEADS)))
add("join_signature", lambda s, d: calls.matched_calls(code(s, d)).groupBy(
        "detector", "family", "rule_id").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files")),
    "SELECT d.detector, m.family, d.rule_id, count(*) AS n, count(DISTINCT m.file_path) AS files "
    "FROM matched_calls m JOIN finding_dim d ON d.dim_idx = m.dim_idx GROUP BY ALL")
RAW_SQL = ("SELECT r.file_path, r.language, r.line::BIGINT AS line, d.rule_id, d.cwe_id, d.severity, d.confidence, "
           "d.detector, r.function_name FROM raw_findings r JOIN finding_dim d ON d.dim_idx = r.dim_idx")
add("detect_all", lambda s, d: shown(merge.detect_all(code(s, d)), *RAW_COLUMNS), RAW_SQL)
add("detect_route", lambda s, d: merge.detect_all(code(s, d)).groupBy("language", "detector").agg(
        F.count("*").alias("n"), F.count_distinct("file_path").alias("files")),
    "SELECT language, detector, count(*) AS n, count(DISTINCT file_path) AS files FROM raw_findings GROUP BY ALL")

# ------------------------------------------------------------------ merging
def _dim(s):
    return dims.finding_dim(s)


def raw(s, d):
    return merge.raw_findings(code(s, d))


add("merge_same_spot", lambda s, d: shown(merge.merge_same_spot(code(s, d)),
        "file_path", "line", "rule_id", "severity", "confidence", "detector", "function_name"),
    """SELECT file_path, line::BIGINT AS line, rule_id, severity, s.conf AS confidence, s.det AS detector,
         s.fn AS function_name
       FROM (SELECT *, s.dim_idx AS dim_idx FROM spots) JOIN finding_dim USING (dim_idx)""")
add("collapse_per_file", lambda s, d: merge.collapse_per_file(code(s, d)).select(
        "file_path", "canon_cwe", "fn_key", *big("line"), "confidence",
        F.array_join(F.col("lines").cast("array<string>"), ", ").alias("lines")),
    """SELECT file_path, canon_cwe, fn_key, s.line::BIGINT AS line, s.conf AS confidence,
         array_to_string(lines, ', ') AS lines FROM merged""")
add("merge_findings", lambda s, d: shown(merge.findings_of(merge.scan_files(code(s, d), minimum="", enriched=False))),
    f"SELECT {FINDING_SQL} FROM merged_findings")
add("merge_table", lambda s, d: shown(merge.merge_findings(raw(s, d))),
    f"SELECT {FINDING_SQL} FROM merged_findings")
add("join_cwe", lambda s, d: shown(merge.enrich(merge.findings_of(merge.scan_files(code(s, d), minimum="", enriched=False)))),
    f"SELECT {FINDING_SQL} FROM findings")
add("scan_findings", lambda s, d: shown(found(s, d)), f"SELECT {FINDING_SQL} FROM findings")


def _streamed(s, d):
    """The findings a stream has written once it has seen all files of the table."""
    folder = f"{checkpoint_folder(s).rstrip('/')}/stream-{uuid.uuid4().hex}"
    scan_stream(corpus.arriving_files(s, d), f"{folder}/out", f"{folder}/state").awaitTermination()
    return shown(s.read.parquet(f"{folder}/out"))


add("scan_stream", _streamed, f"SELECT {FINDING_SQL} FROM findings")
add("report_order", lambda s, d: shown(merge.report_order(found(s, d))),
    f"SELECT {FINDING_SQL} FROM findings ORDER BY {REPORT_RANK}, file_path, line, seq")
add("min_severity", lambda s, d: shown(found(s, d, "high")),
    f"SELECT {FINDING_SQL} FROM findings WHERE {SEVERITY_RANK} >= 3")
add("significant", lambda s, d: shown(analyze.significant(found(s, d))),
    f"SELECT {FINDING_SQL} FROM findings WHERE severity IN ('critical', 'high', 'medium')")

# ------------------------------------------------------------------ counts and rollups
COUNTS = ", ".join(f"count(*) FILTER (severity = '{x}') AS {x}" for x in analyze.SEVERITIES)
add("severity_counts", lambda s, d: analyze.severity_counts(merge.findings_of(slim(s, d, "severity"))),
    f"SELECT count(*) AS total_findings, {COUNTS} FROM findings")
def _summary(s, d):
    return analyze.summary(slim(s, d, "severity", minimum=""), "orders", "low", 1.005)


add("scan_summary", _summary,
    f"""SELECT 'orders' AS target, (SELECT count(*) FROM code_files) AS files_scanned,
         (SELECT count(DISTINCT file_path) FROM raw_findings) AS files_with_issues,
         count(*) AS total_findings, {COUNTS}, 1.0::DOUBLE AS duration_seconds FROM findings""")
add("sev_percent", lambda s, d: analyze.severity_percent(merge.findings_of(slim(s, d, "severity"))),
    "SELECT " + ", ".join(f"round_even(count(*) FILTER (severity = '{x}') / greatest(count(*), 1) * 100, 0)::BIGINT "
                          f"AS {x}_pct" for x in analyze.SEVERITIES[:4]) + " FROM findings")
add("by_file", lambda s, d: analyze.by_file(slim(s, d, "rule_id")).select(
        "file_path", F.size("findings").cast("bigint").alias("n"),
        F.array_join(F.transform("findings", lambda f: F.concat_ws("@", f["rule_id"], f["line"].cast("string"))), ",")
        .alias("findings")),
    f"SELECT file_path, count(*) AS n, string_agg(rule_id || '@' || line, ',' ORDER BY {REPORT_RANK}, line, seq) "
    "AS findings FROM findings GROUP BY file_path")
add("files_with_issues", lambda s, d: analyze.files_with_issues(slim(s, d, minimum="")),
    "SELECT count(DISTINCT file_path) AS files_with_issues FROM raw_findings")
add("project_info", lambda s, d: analyze.project_info(all_files(s, d)).select(
        *big("file_count", "total_lines", "total_code_lines"),
        F.col("languages")["c"].alias("c_files"), F.col("languages")["cpp"].alias("cpp_files")),
    f"""SELECT count(*) AS file_count, sum({TOTAL_LINES})::BIGINT AS total_lines,
         sum({CODE_LINES})::BIGINT AS total_code_lines, count(*) FILTER (language = 'c') AS c_files,
         count(*) FILTER (language = 'cpp') AS cpp_files {T}""")
SAFE = f"regexp_matches(lower({BASE}), 'safe|_fixed|_good')"
SCORES = f"""SELECT c.file_path, regexp_extract(c.file_path, '[^/]*$') AS file_name, coalesce(n, 0)::BIGINT AS findings,
   CASE WHEN {SAFE.replace('file_path', 'c.file_path')} THEN 'safe' ELSE 'vuln' END AS expected,
   CASE WHEN {SAFE.replace('file_path', 'c.file_path')} THEN CASE WHEN coalesce(sig, 0) > 0 THEN 'FP' ELSE 'TN' END
        WHEN coalesce(sig, 0) > 0 THEN 'TP' ELSE 'FN' END AS result
 FROM code_files c LEFT JOIN (SELECT file_path, count(*) AS n,
   count(*) FILTER (severity IN ('critical', 'high', 'medium')) AS sig FROM merged_findings GROUP BY 1) f
   ON f.file_path = c.file_path"""


def _scores(s, d):
    return analyze.bench_file(merge.scan_files(code(s, d), minimum="", enriched=False))


add("bench_file", _scores, SCORES)
add("bench_metrics", lambda s, d: analyze.bench_metrics(_scores(s, d)).select(
        *big("total_files", "total_findings", "tp", "tn", "fp", "fn"),
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")]),
    """SELECT total_files, total_findings, tp, tn, fp, fn, round(coalesce(p, 0), 6) AS precision,
         round(coalesce(r, 0), 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1,
         round((tp + tn)::DOUBLE / total_files, 6) AS accuracy
       FROM (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS p, tp::DOUBLE / nullif(tp + fn, 0) AS r FROM (
         SELECT count(*) AS total_files, sum(findings)::BIGINT AS total_findings,
           count(*) FILTER (result = 'TP') AS tp, count(*) FILTER (result = 'TN') AS tn,
           count(*) FILTER (result = 'FP') AS fp, count(*) FILTER (result = 'FN') AS fn FROM scores))""", scores=SCORES)
add("fix_split_counts", lambda s, d: patch.fix_split_counts(found(s, d)),
    "SELECT count(*) FILTER (function_name IN (" + ", ".join(lit(f) for f in dims.TEMPLATE_FUNCTIONS)
    + ")) AS template_fixes, count(*) FILTER (function_name NOT IN ("
    + ", ".join(lit(f) for f in dims.TEMPLATE_FUNCTIONS) + ")) AS other_fixes FROM findings")
add("distinct_files", lambda s, d: analyze.distinct_files(found(s, d)),
    "SELECT DISTINCT file_path FROM findings ORDER BY file_path")


def _categories(s, d):
    dim = F.broadcast(_dim(s))
    return analyze.rules_by_category(detect.rule_counts(code(s, d)).join(dim, F.col("dim") == dim["dim_idx"]))


add("rules_by_category", _categories,
    """SELECT r.category, r.severity, r.n AS rules, coalesce(h.n, 0)::BIGINT AS hits FROM
         (SELECT category, severity, count(*) AS n FROM rules GROUP BY ALL) r LEFT JOIN
         (SELECT category, severity, count(*) AS n FROM rule_hits JOIN finding_dim USING (dim_idx) GROUP BY ALL) h
         ON h.category = r.category AND h.severity = r.severity""")
add("top_files", lambda s, d: analyze.top_files(code(s, d)),
    f"""SELECT {BASE} AS file_name, file_path AS path, language, {TOTAL_LINES}::BIGINT AS total_lines,
         {CODE_LINES}::BIGINT AS code_lines, len({FUNCTIONS})::BIGINT AS functions, len({INCLUDES})::BIGINT AS includes
       FROM code_files ORDER BY file_path LIMIT 50""")
add("bottom_up", lambda s, d: found(s, d).groupBy("file_path").agg(
        F.array_join(F.sort_array(F.collect_list("line"), asc=False).cast("array<string>"), ",").alias("lines")),
    "SELECT file_path, string_agg(line::VARCHAR, ',' ORDER BY line DESC) AS lines FROM findings GROUP BY file_path")

# ------------------------------------------------------------------ searches
HAYSTACK = ["description", "file_path", "cwe_id", "rule_id", "recommendation"]
add("search_findings", lambda s, d: shown(analyze.search_findings(found(s, d), "OverFlow", "high")),
    f"SELECT {FINDING_SQL} FROM findings WHERE severity = 'high' AND ("
    + " OR ".join(f"contains(lower({c}), 'overflow')" for c in HAYSTACK) + ")")
add("search_rules", lambda s, d: analyze.search_rules(
        analyze.rule_usage(detect.scan_rules(code(s, d))), "Malloc").select("id", "name", "cwe_id", "hits"),
    """SELECT id, name, cwe_id, coalesce(n, 0)::BIGINT AS hits FROM rules
       LEFT JOIN (SELECT dim_idx, count(*) AS n FROM rule_hits GROUP BY 1) h ON h.dim_idx = rule_ord
       WHERE contains(lower(name), 'malloc') OR contains(lower(cwe_id), 'malloc')
          OR contains(lower(description), 'malloc') OR contains(lower(id), 'malloc')""")

# ------------------------------------------------------------------ range pairs
def _pairs(s, d):
    free = r"\bfree\s*\(\s*(\w+)\s*\)"
    f = code(s, d)
    return (analyze.seq_pairs(f, free, free, 200, same_argument=True).withColumn("kind", F.lit("free-free"))
            .unionByName(analyze.seq_pairs(f, r"\baccess\s*\([^)]+\)", r"\bopen\s*\(", 300)
                         .withColumn("kind", F.lit("access-open"))))


def _pairs_sql(kind, first, second, gap, same):
    side = lambda p: (f"SELECT file_path, length(before) AS st, length(before) + length(hit) AS en, "
                      f"{'regexp_extract(hit, ' + lit(p) + ', 1)' if same else lit('')} AS arg FROM (SELECT file_path, k, "
                      f"h[k] AS hit, array_to_string(list_transform(list_zip(g, h)[1:k-1], lambda z: z[1] || z[2]), '') || g[k] "
                      f"AS before FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM (SELECT file_path, "
                      f"string_split_regex(neut, {lit(p)}) AS g, regexp_extract_all(neut, {lit(p)}) AS h FROM neutral)))")
    return (f"SELECT a.file_path, a.arg, a.st::BIGINT AS first_start, a.en::BIGINT AS first_end, min(b.st)::BIGINT "
            f"AS second_start, '{kind}' AS kind FROM ({side(first)}) a JOIN ({side(second)}) b ON a.file_path = b.file_path "
            f"AND a.arg = b.arg AND b.st BETWEEN a.en AND a.en + {gap} GROUP BY ALL")


add("seq_pairs", _pairs,
    _pairs_sql("free-free", r"\bfree\s*\(\s*(\w+)\s*\)", r"\bfree\s*\(\s*(\w+)\s*\)", 200, True) + " UNION ALL "
    + _pairs_sql("access-open", r"\baccess\s*\([^)]+\)", r"\bopen\s*\(", 300, False))

# ------------------------------------------------------------------ patching
FIX_FUNCTIONS = ", ".join(lit(f) for f in dims.TEMPLATE_FUNCTIONS)


def _template_sql(line: str, fn: str) -> str:
    """The fix templates over RE2; null where the pattern does not match."""
    def two(pattern, build):
        g = lambda i: f"trim(regexp_extract({line}, {lit(pattern)}, {i}))"
        indent = f"regexp_extract({line}, '^(\\s*)', 1)"
        return f"CASE WHEN regexp_matches({line}, {lit(pattern)}) THEN {build(g(1), g(2), indent)} END"

    args = lambda f: rf"\b{f}\s*\(\s*([^,]+)\s*,\s*([^)]+)\s*\)"
    rest = lambda f: rf"\b{f}\s*\(\s*([^,]+)\s*,\s*(.+)\s*\)"
    gets = r"^(.*?)\bgets\s*\(\s*([^)]+)\s*\)(.*)$"
    scanf = r'^(.*?\bscanf\s*\(\s*"[^"]*)%s([^"]*".*)$'
    buf = f"trim(regexp_extract({line}, {lit(gets)}, 2))"
    cases = {
        "gets": f"CASE WHEN regexp_matches({line}, {lit(gets)}) THEN regexp_extract({line}, {lit(gets)}, 1) || 'fgets(' "
                f"|| {buf} || ', sizeof(' || {buf} || '), stdin)' || regexp_extract({line}, {lit(gets)}, 3) END",
        "strcpy": two(args("strcpy"), lambda d, s, i: f"{i} || 'strncpy(' || {d} || ', ' || {s} || ', sizeof(' || {d} || ') - 1);' "
                      f"|| chr(10) || {i} || {d} || '[sizeof(' || {d} || ') - 1] = ''\\0'';'"),
        "strcat": two(args("strcat"), lambda d, s, i: f"{i} || 'strncat(' || {d} || ', ' || {s} || ', sizeof(' || {d} "
                      f"|| ') - strlen(' || {d} || ') - 1);'"),
        "sprintf": two(rest("sprintf"), lambda d, s, i: f"{i} || 'snprintf(' || {d} || ', sizeof(' || {d} || '), ' || {s} || ');'"),
        "vsprintf": two(rest("vsprintf"), lambda d, s, i: f"{i} || 'vsnprintf(' || {d} || ', sizeof(' || {d} || '), ' || {s} || ');'"),
        "scanf": f"CASE WHEN regexp_matches({line}, {lit(scanf)}) THEN regexp_extract({line}, {lit(scanf)}, 1) || '%255s' "
                 f"|| regexp_extract({line}, {lit(scanf)}, 2) END",
        "wcscpy": two(args("wcscpy"), lambda d, s, i: f"{i} || 'wcsncpy(' || {d} || ', ' || {s} || ', sizeof(' || {d} || ')/sizeof(' "
                      f"|| {d} || '[0]) - 1);' || chr(10) || {i} || {d} || '[sizeof(' || {d} || ')/sizeof(' || {d} "
                      f"|| '[0]) - 1] = L''\\0'';'"),
    }
    return f"CASE {fn} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + " END"


HEAD_OF = "regexp_extract(a.t, '^[^\\n]*')"
NEW_HEAD = _template_sql(HEAD_OF, "x.fn")
PATCH_CTES = {
    "edits": f"""SELECT file_path, line, list_sort(list({{'r': {REPORT_RANK}, 'seq': seq, 'fn': function_name,
        't': '', 'ok': []::BIGINT[]}})) AS e FROM findings WHERE function_name IN ({FIX_FUNCTIONS}) GROUP BY file_path, line""",
    "plines": f"""SELECT file_path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS old FROM
        (SELECT file_path, {LINES} AS ls FROM code_files WHERE file_path IN (SELECT file_path FROM edits))""",
    "blocks": f"""SELECT file_path, line, old, coalesce(s.t, old) AS new, coalesce(s.ok, []::BIGINT[]) AS ok FROM (
        SELECT p.file_path, p.line, p.old, CASE WHEN e.e IS NOT NULL THEN list_reduce(list_prepend(
            {{'r': -1, 'seq': 0::BIGINT, 'fn': '', 't': p.old, 'ok': []::BIGINT[]}}, e.e),
          lambda a, x: {{'r': x.r, 'seq': x.seq, 'fn': x.fn,
            't': coalesce({NEW_HEAD} || a.t[length({HEAD_OF}) + 1:], a.t),
            'ok': CASE WHEN {NEW_HEAD} IS NULL THEN a.ok ELSE list_append(a.ok, x.seq) END}}) END AS s
        FROM plines p LEFT JOIN edits e ON e.file_path = p.file_path AND e.line = p.line)""",
    "fixed": """SELECT file_path, string_agg(old, chr(10) ORDER BY line) AS code,
        string_agg(new, chr(10) ORDER BY line) AS fixed_code FROM blocks GROUP BY file_path
        HAVING string_agg(old, chr(10) ORDER BY line) <> string_agg(new, chr(10) ORDER BY line)""",
    "changed": "SELECT file_path, line, old, new FROM blocks WHERE old <> new",
}


def fixed(s, d):
    return patch.fix_files(scanned(s, d))


add("can_template_fix", lambda s, d: found(s, d).select(
        "file_path", "rule_id", "function_name", patch.can_template_fix(F.col("function_name")).alias("fixable")),
    f"SELECT file_path, rule_id, function_name, function_name IN ({FIX_FUNCTIONS}) AS fixable FROM findings")


def _lines_with(fn: str) -> Query:
    """Each template over every line of every file that names the function."""
    def run(s, d):
        lines = code(s, d).select("file_path", F.posexplode(text.lines_of(F.col("code"))).alias("i", "old"))
        return lines.where(F.contains("old", F.lit(fn))).select(
            "file_path", (F.col("i") + 1).cast("bigint").alias("line"), "old", patch.template_fix(F.col("old"), next(t for t in patch.TEMPLATES if fn in t.functions)).alias("fixed"))
    return run


for _fn in dims.TEMPLATE_FUNCTIONS:
    add(f"fix_{_fn}", _lines_with(_fn),
        f"SELECT file_path, line::BIGINT AS line, old, {_template_sql('old', lit(_fn))} AS fixed FROM every_line "
        f"WHERE contains(old, '{_fn}')",
        every_line=f"SELECT file_path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS old "
                   f"FROM (SELECT file_path, {LINES} AS ls FROM code_files)")
add("try_template_fix", lambda s, d: code(s, d).select(
        "file_path", F.posexplode(text.lines_of(F.col("code"))).alias("i", "old")).select(
        "file_path", (F.col("i") + 1).cast("bigint").alias("line"), patch.try_template_fix(
            F.col("old"), F.upper(text.call_name(F.col("old")))).alias("fixed")),
    "SELECT file_path, line::BIGINT AS line, CASE WHEN fn = '' THEN coalesce("
    + ", ".join(_template_sql("old", lit(x)) for x in dims.TEMPLATE_FUNCTIONS)
    + f") ELSE {_template_sql('old', 'fn')} END AS fixed FROM (SELECT *, regexp_extract(old, "
    "'\\b(\\w+)\\s*\\(', 1) AS fn FROM every_line)",
    every_line=f"SELECT file_path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS old "
               f"FROM (SELECT file_path, {LINES} AS ls FROM code_files)")
add("apply_templates", lambda s, d: patch.apply_templates(scanned(s, d)).select(
        "file_path", F.array_join("blocks", "\n").alias("fixed_code"), F.size("applied").cast("bigint").alias("applied")),
    "SELECT file_path, string_agg(new, chr(10) ORDER BY line) AS fixed_code, sum(len(ok))::BIGINT AS applied "
    "FROM blocks GROUP BY file_path", **PATCH_CTES)
add("fix_file", lambda s, d: fixed(s, d).select("file_path", "fixed_code"),
    "SELECT file_path, fixed_code FROM fixed", **PATCH_CTES)


def _remaining(s, d):
    return patch.remaining_findings(scanned(s, d)).select(
        "file_path", F.col("original_line").cast("bigint").alias("line"), "rule_id", "function_name")


add("fix_remaining", _remaining,
    """SELECT f.file_path, f.line::BIGINT AS line, rule_id, function_name FROM findings f
       LEFT JOIN (SELECT file_path, unnest(ok) AS seq FROM blocks) b ON b.file_path = f.file_path AND b.seq = f.seq
       WHERE b.seq IS NULL""", **PATCH_CTES)


def _shifted(s, d):
    return patch.line_shift(scanned(s, d)).select("file_path", "rule_id", "function_name", *big("line", "fixed_line"))


add("line_shift", _shifted,
    """SELECT f.file_path, rule_id, function_name, f.line::BIGINT AS line, (f.line + coalesce((SELECT sum(
         length(new) - length(replace(new, chr(10), ''))) FROM changed c
         WHERE c.file_path = f.file_path AND c.line < f.line), 0))::BIGINT AS fixed_line FROM findings f""", **PATCH_CTES)
add("patch_lines", lambda s, d: patch.patch_lines(fixed(s, d)).select(
        "file_path", *big("line", "ordinal"), "op", "text"),
    """SELECT file_path, line::BIGINT AS line, 0::BIGINT AS ordinal, '-' AS op, old AS text FROM changed UNION ALL
       SELECT file_path, line, unnest(range(1, len(ls) + 1)), '+', unnest(ls) FROM
         (SELECT file_path, line, string_split(new, chr(10)) AS ls FROM changed)""", **PATCH_CTES)
PATCH_COUNTS = ("SELECT file_path, sum(1 + length(new) - length(replace(new, chr(10), '')))::BIGINT AS additions, "
                "count(*) AS deletions FROM changed GROUP BY file_path")
add("patch_counts", lambda s, d: patch.patch_counts(patch.patch_lines(fixed(s, d))), PATCH_COUNTS, **PATCH_CTES)
def _plain_diffs(s, d):
    return patch.unified_diff(fixed(s, d)).select(
        "filename", F.col("file_path").alias("original_path"), F.concat(F.lit("/out/"), "filename").alias("fixed_path"), "diff",
        "additions", "deletions", F.lit(False).alias("applied"))


# rows of a hunk: a context line or removed line comes from the original, the new lines of a run of
# changed lines follow its last removed one
DIFF_CTES = PATCH_CTES | {
    "hunks": """SELECT *, sum(CASE WHEN gap IS NULL OR gap > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line) AS h,
        line - row_number() OVER (PARTITION BY file_path ORDER BY line) AS run, length(new) - length(replace(new, chr(10), '')) AS gain
        FROM (SELECT *, line - lag(line) OVER (PARTITION BY file_path ORDER BY line) AS gap FROM changed)""",
    "spans": """SELECT *, coalesce(sum(gain) OVER (PARTITION BY file_path ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT x.file_path, h, greatest(1, min(x.line) - 3) AS a, least(any_value(n), max(x.line) + 3) AS b, sum(gain) AS gain
        FROM hunks x JOIN (SELECT file_path, max(line) AS n FROM blocks GROUP BY 1) t ON t.file_path = x.file_path GROUP BY x.file_path, h)""",
    "pieces": """SELECT s.file_path, s.h, b.line AS pos, 0 AS part, 0 AS nth, CASE WHEN b.old <> b.new THEN '-' ELSE ' ' END || b.old AS t
        FROM spans s JOIN blocks b ON b.file_path = s.file_path AND b.line BETWEEN s.a AND s.b
      UNION ALL SELECT c.file_path, c.h, max(c.line) OVER (PARTITION BY c.file_path, c.run), 1, c.line,
        '+' || replace(c.new, chr(10), chr(10) || '+') FROM hunks c""",
    "rendered": """SELECT s.file_path, s.h, '@@ -' || a || CASE WHEN b - a <> 0 THEN ',' || (b - a + 1) ELSE '' END || ' +' || (a + before)::BIGINT
        || CASE WHEN b - a + gain <> 0 THEN ',' || (b - a + 1 + gain)::BIGINT ELSE '' END || ' @@' || chr(10)
        || body AS t FROM spans s JOIN (SELECT file_path, h, string_agg(t, chr(10) ORDER BY pos, part, nth) AS body FROM pieces GROUP BY ALL) p
        ON p.file_path = s.file_path AND p.h = s.h""",
}
RECORD_SQL = f"""SELECT {BASE} AS filename, file_path AS original_path, '/out/' || {BASE} AS fixed_path,
     '--- original/' || {BASE} || chr(10) || '+++ fixed/' || {BASE} || chr(10) || string_agg(t, chr(10) ORDER BY h) AS diff,
     any_value(additions) AS additions, any_value(deletions) AS deletions, false AS applied
   FROM rendered JOIN counts USING (file_path) GROUP BY file_path"""
add("fixes_list", lambda s, d: patch.fix_record(fixed(s, d), "/out/"), RECORD_SQL, counts=PATCH_COUNTS, **DIFF_CTES)
add("fix_diffs", _plain_diffs, RECORD_SQL, counts=PATCH_COUNTS, **DIFF_CTES)
add("sink_fixed", lambda s, d: sinks.with_out_path(fixed(s, d).select("file_path", "fixed_code"), "/out/").select("file_path", "out_path"),
    f"""SELECT file_path, '/out/' || CASE WHEN (SELECT count(DISTINCT {BASE}) <> count(*) FROM fixed)
         THEN regexp_extract(file_path, '([^/]*)/[^/]*$', 1) || '/' ELSE '' END || {BASE} AS out_path FROM fixed""",
    **PATCH_CTES)
add("fix_publish", lambda s, d: sinks.publish(fixed(s, d)),
    f"""SELECT {BASE} AS filename, file_path AS original_path, file_path || '.bak' AS backup_path, fixed_code AS code,
         'applied' AS status, NULL::VARCHAR AS error FROM fixed""", **PATCH_CTES)


def _slim(s, d):
    """Findings of all files and whether a template changes the file, without the texts, written
    once: both joins below read it several times."""
    files = patch.all_fixed(scanned(s, d)).select("file_path", "findings", F.col("fixed_code").isNotNull().alias("changed"))
    return materialized(files)


def _originals(s, d):
    files = _slim(s, d)
    return analyze.fix_original(files.where("changed").select("file_path"), merge.findings_of(files), files)


add("join_fix_original", _originals,
    f"""SELECT DISTINCT {BASE} AS filename, file_path AS original_path FROM fixed""", **PATCH_CTES)
def _fix_states(s, d):
    files = _slim(s, d)
    return analyze.fix_state(merge.findings_of(files), files.where("changed").select("file_path")).select(
        "file_path", *big("line"), "rule_id", "function_name", "fix_state")


add("has_fix", _fix_states,
    """SELECT f.file_path, f.line::BIGINT AS line, rule_id, function_name, CASE WHEN x.file_path IS NOT NULL THEN 'Fixed'
         WHEN recommendation <> '' THEN 'Rec.' ELSE '—' END AS fix_state
       FROM findings f LEFT JOIN fixed x ON x.file_path = f.file_path""", **PATCH_CTES)
# detecting again needs the whole detector chain over the fixed texts
_AGAIN = {f"again_{n}": CTES[n] for n in ("neutral1", "neutral2", "neutral3", "neutral", "rule_hits", "lexed1", "lexed",
                                           "call_hits", "matched_calls", "raw_findings")}
for _n in list(_AGAIN):
    for _m in ("neutral1", "neutral2", "neutral3", "neutral", "rule_hits", "lexed1", "lexed", "call_hits",
               "matched_calls"):
        _AGAIN[_n] = _AGAIN[_n].replace(f"FROM {_m} ", f"FROM again_{_m} ").replace(
            f"FROM {_m})", f"FROM again_{_m})").replace(f"FROM {_m}\n", f"FROM again_{_m}\n")
        if _AGAIN[_n].endswith(f"FROM {_m}"):
            _AGAIN[_n] = _AGAIN[_n][:-len(_m)] + f"again_{_m}"
    _AGAIN[_n] = _AGAIN[_n].replace("FROM code_files", "FROM fixed_files")
_AGAIN["fixed_files"] = ("SELECT f.file_path, c.language, f.fixed_code AS code FROM fixed f "
                         "JOIN code_files c ON c.file_path = f.file_path")
add("rescan_high", lambda s, d: shown(patch.rescan_high(fixed(s, d)), *RAW_COLUMNS),
    RAW_SQL.replace("raw_findings", "again_raw_findings") + " WHERE d.severity IN ('critical', 'high')",
    **PATCH_CTES, **_AGAIN)

# ------------------------------------------------------------------ review by a model: answers derived from the findings
ID_SQL = "file_path || ':' || rule_id || ':' || function_name || ':' || line"
VERDICTS = ["Confirmed: YES\nReason: unbounded copy", "confirmed: no", "Rejected - guarded above", "I cannot tell"]


def _verdicts(f: DataFrame) -> DataFrame:
    key = assist.finding_id()
    slot = (F.length(key) * 7 + F.col("line")) % 5
    return f.select(key.alias("finding_id"), F.get(F.array(*[F.lit(v) for v in VERDICTS]), slot).alias("response")).where(
        "response IS NOT NULL")


VERDICTS_SQL = (f"SELECT * FROM (SELECT {ID_SQL} AS finding_id, [" + ", ".join(
    " || chr(10) || ".join(lit(p) for p in v.split("\n")) for v in VERDICTS)
    + f"][(length({ID_SQL}) * 7 + line) % 5 + 1] AS response FROM findings) WHERE response IS NOT NULL")


def _judged(s, d):
    f = materialized(found(s, d))
    return assist.apply_verdicts(f, _verdicts(f)).select(
        "finding_id", "confidence", "llm_confirmed", "llm_confidence", "llm_explanation")


JUDGED_SQL = f"""SELECT finding_id, c AS confidence, v AS llm_confirmed, CASE WHEN response IS NOT NULL THEN c END
    AS llm_confidence, coalesce(response, '') AS llm_explanation FROM (SELECT *,
      CASE WHEN v THEN least(1.0::DOUBLE, confidence + 0.25::DOUBLE)
           WHEN NOT v THEN greatest(0.0::DOUBLE, confidence - 0.3::DOUBLE) ELSE confidence END AS c
    FROM (SELECT f.finding_id, f.confidence, r.response, CASE WHEN contains(upper(r.response), 'CONFIRMED: YES') THEN true
       WHEN contains(upper(r.response), 'CONFIRMED: NO') OR contains(upper(r.response), 'REJECTED') THEN false END AS v
     FROM (SELECT *, {ID_SQL} AS finding_id FROM findings) f LEFT JOIN responses r ON r.finding_id = f.finding_id))"""
add("apply_verdicts", _judged, JUDGED_SQL, responses=VERDICTS_SQL)
add("join_verdict", lambda s, d: _judged(s, d).groupBy("llm_confirmed").agg(F.count("*").alias("n")),
    "SELECT llm_confirmed, count(*) AS n FROM judged GROUP BY ALL", responses=VERDICTS_SQL, judged=JUDGED_SQL)

SNIP = ("array_to_string(string_split(c.code, chr(10))[greatest(0, f.line - 6) + 1 : "
        "least(len(string_split(c.code, chr(10))), f.line + 5)], chr(10))")
SNIPPED = (f"SELECT f.*, {ID_SQL.replace('file_path', 'f.file_path')} AS finding_id, {SNIP} AS snippet "
           "FROM findings f JOIN code_files c ON c.file_path = f.file_path")


def _prompt_sql(template: str, source: str, *keys: str) -> str:
    parts = []
    for piece in template.replace("{", "\0{").replace("}", "\0").split("\0"):
        if piece.startswith("{"):
            parts.append(piece[1:])
        elif piece:
            parts.append(" || chr(10) || ".join(lit(x) for x in piece.split("\n")))
    return f"SELECT {', '.join(keys)}, {' || '.join(parts)} AS prompt FROM {source}"


add("join_snippet", lambda s, d: analyze.with_snippet(scanned(s, d)).select(
        "file_path", *big("line"), "rule_id", "function_name", "snippet"),
    "SELECT file_path, line::BIGINT AS line, rule_id, function_name, snippet FROM snipped", snipped=SNIPPED)
add("reason_prompts", lambda s, d: assist.reason_prompts(scanned(s, d)),
    _prompt_sql(assist.REASON_PROMPT, "snipped", "finding_id"), snipped=SNIPPED)
# prompts for a fix show the text that the templates leave, at the finding's new place
LEFT_CTES = PATCH_CTES | {
    "templated": """SELECT c.file_path, coalesce(b.t, c.code) AS code FROM code_files c LEFT JOIN
        (SELECT file_path, string_agg(new, chr(10) ORDER BY line) AS t FROM blocks GROUP BY 1) b ON b.file_path = c.file_path""",
    "left_findings": f"""SELECT f.* REPLACE (f.line + coalesce((SELECT sum(length(new) - length(replace(new, chr(10), '')))::BIGINT
          FROM changed c WHERE c.file_path = f.file_path AND c.line < f.line), 0)::BIGINT AS line), f.line AS original_line,
          {ID_SQL.replace('file_path', 'f.file_path').replace('line', 'f.line')} AS finding_id
        FROM findings f LEFT JOIN (SELECT file_path, unnest(ok) AS seq FROM blocks) b ON b.file_path = f.file_path AND b.seq = f.seq
        WHERE b.seq IS NULL""",
    "snipped_left": f"SELECT f.*, {SNIP} AS snippet FROM left_findings f JOIN templated c ON c.file_path = f.file_path",
}
for _key, _run, _template in [("fix_prompts", patch.fix_prompts, assist.FIX_PROMPT), ("snippet_prompts", patch.snippet_prompts, assist.SNIPPET_PROMPT)]:
    add(_key, lambda s, d, run=_run: run(patch.remaining(scanned(s, d))),
        _prompt_sql(_template, "snipped_left", "finding_id"), **LEFT_CTES)
add("batch_prompts", lambda s, d: assist.batch_prompts(scanned(s, d)),
    _prompt_sql(assist.BATCH_PROMPT, "batches", "file_path"),
    batches="""SELECT c.file_path, any_value(c.code) AS snippet, string_agg('  - Line ' || f.line || ': ' || f.vuln_type
       || ' (' || f.cwe_id || ')', chr(10) ORDER BY f.line, f.seq) AS issues
       FROM findings f JOIN code_files c ON c.file_path = f.file_path GROUP BY c.file_path""")

ANSWERS = [
    "```c\n  checked(b0);\n  done();\n  more();\n  x();\n```\nNote: bounded now", "  plain();\n  two();\n\n  four();\nThe fix limits it.",
    "text\n``` \n```\nEXPLANATION: nothing", "  ", "a();\nb();\nc();\n  This fix is short", "one line only",
    "```\nopen block\n  kept\nlast\nand one",
]


def _answer(key, line=None):
    return F.get(F.array(*[F.lit(v) for v in ANSWERS]), (F.length(key) * 3 + (F.col("line") if line is None else line)) % 9)


ANSWER_SQL = "[" + ", ".join(" || chr(10) || ".join(lit(p) for p in v.split("\n")) for v in ANSWERS) + \
    f"][(length({ID_SQL}) * 3 + line) % 9 + 1]"


def _sql_clean(x: str) -> str:
    strip = lambda v: f"regexp_replace({v}, '^[{WS}]+|[{WS}]+$', '', 'g')"
    fence = rf"(?m)^[{WS_LINE}]*```[^\n]*(?:\n|\z)"
    t = strip(x)
    parts = (f"list_filter(list_transform(string_split_regex({t}, {lit(fence)}), lambda p, i: CASE WHEN i % 2 = 0 AND p <> '' "
             f"THEN CASE WHEN ends_with(p, chr(10)) THEN p ELSE p || chr(10) END END), lambda p: p IS NOT NULL)")
    joined = f"array_to_string({parts}, '')"
    body = f"CASE WHEN contains({t}, '```') AND {joined} <> '' THEN {joined}[:-2] ELSE {t} END"
    cut = "(?mi)^[" + WS_LINE + "]*(?:" + "|".join(assist.CUT_MARKERS) + ")[\\s\\S]*"
    return strip(f"regexp_replace({body}, {lit(cut)}, '')")


add("clean_response", lambda s, d: found(s, d).select(
        assist.finding_id().alias("finding_id"), _answer(assist.finding_id()).alias("response")).select(
        "finding_id", assist.clean_response(F.col("response")).alias("cleaned")),
    f"SELECT finding_id, {_sql_clean('response')} AS cleaned FROM (SELECT {ID_SQL} AS finding_id, {ANSWER_SQL} "
    "AS response FROM findings)")


def _with_answer(s, d, name):
    return assist.with_answers(scanned(s, d), lambda key, f: _answer(key, f["line"]), name)


# splices fold over a file's lines; recursion over findings, last line first
def _splice_sql(start: str, end: str, new: str, ok: str, value: str) -> str:
    return f"""WITH RECURSIVE ranked AS (SELECT file_path, line, {value} AS v, row_number() OVER (PARTITION BY file_path
        ORDER BY line DESC, {REPORT_RANK}, seq) AS n FROM findings WHERE {value} IS NOT NULL AND {value} <> ''),
      walk AS (SELECT c.file_path, 0 AS n, string_split(c.code, chr(10)) AS ls FROM code_files c
        WHERE c.file_path IN (SELECT file_path FROM ranked)
        UNION ALL
        SELECT file_path, n, CASE WHEN {ok} THEN ls[1:a] || nl || ls[greatest(a, b) + 1:] ELSE ls END FROM (
          SELECT w.file_path, r.n, w.ls, {start} AS a, {end} AS b, {new} AS nl, r.v
          FROM walk w JOIN ranked r ON r.file_path = w.file_path AND r.n = w.n + 1)),
      last AS (SELECT file_path, arg_max(ls, n) AS ls FROM walk GROUP BY file_path)
      SELECT file_path, array_to_string(ls, chr(10)) AS fixed_code FROM last"""


def _splice_oracle(body: str) -> str:
    """Put the shared steps in front of a recursive statement."""
    head = q("SELECT 1 FROM findings JOIN code_files USING (file_path)")
    return head[:head.rindex("\nSELECT 1")].replace("WITH ", "WITH RECURSIVE ", 1) + ", " + body.split(
        "WITH RECURSIVE ", 1)[1]


add("apply_llm_fix", lambda s, d: patch.apply_llm_fix(_with_answer(s, d, "llm_fix")).select(
        "file_path", "fixed_code"))
ORACLES["apply_llm_fix"] = _splice_oracle(_splice_sql(
    "greatest(0, r.line - 6)", "least(len(w.ls), r.line + 5)", "string_split(r.v, chr(10))", "true", ANSWER_SQL))
add("snippet_splice", lambda s, d: patch.snippet_splice(_with_answer(s, d, "response")).select(
        "file_path", "fixed_code"))
ORACLES["snippet_splice"] = _splice_oracle(_splice_sql(
    "greatest(0, r.line - 6)", "least(len(w.ls), r.line + 5)", "string_split(" + _sql_clean("r.v") + ", chr(10))",
    "nl <> [''] AND len(nl) >= (b - a) * 0.3::DOUBLE AND len(nl) <= (b - a) * 3", ANSWER_SQL))
add("fix_two_tiers", lambda s, d: patch.fix_two_tiers(assist.with_answers(
        patch.remaining(scanned(s, d)), lambda key, f: _answer(key, f["original_line"]))).select("file_path", "fixed_code"))
_TWO = _splice_sql(
    "greatest(0, r.line - 6)", "least(len(w.ls), r.line + 5)", "string_split(" + _sql_clean("r.v") + ", chr(10))",
    "nl <> [''] AND len(nl) >= (b - a) * 0.3::DOUBLE AND len(nl) <= (b - a) * 3", "v0")
_TWO = _TWO.replace("FROM findings WHERE", "FROM (SELECT *, " + ANSWER_SQL.replace(ID_SQL, "finding_id").replace("+ line)", "+ original_line)")
                    + " AS v0 FROM left_findings) WHERE").replace("FROM code_files c", "FROM templated c")
_TWO = _TWO.replace("SELECT file_path, array_to_string(ls, chr(10)) AS fixed_code FROM last", f"""SELECT c.file_path, coalesce(array_to_string(ls, chr(10)), t.code)
      AS fixed_code FROM code_files c JOIN templated t ON t.file_path = c.file_path LEFT JOIN last l ON l.file_path = c.file_path
      WHERE regexp_replace(coalesce(array_to_string(ls, chr(10)), t.code), '^[{WS}]+|[{WS}]+$', '', 'g') <> regexp_replace(c.code, '^[{WS}]+|[{WS}]+$', '', 'g')""")
_TWO_HEAD = q("SELECT 1 FROM left_findings JOIN templated USING (file_path)", **LEFT_CTES)
ORACLES["fix_two_tiers"] = _TWO_HEAD[:_TWO_HEAD.rindex("\nSELECT 1")].replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _TWO.split("WITH RECURSIVE ", 1)[1]
add("patch_one", lambda s, d: patch.patch_one(_with_answer(s, d, "llm_fix")).select(
        assist.finding_id().alias("finding_id"), "patch"),
    f"""SELECT finding_id, CASE WHEN coalesce(v, '') = '' THEN '' ELSE '--- a/' || base || chr(10) || '+++ b/' || base
         || chr(10) || '@@ -' || st || ',' || len(o) || ' +' || st || ',' || len(nw) || ' @@' || chr(10)
         || array_to_string(list_transform(o, lambda x: '-' || x) || list_transform(nw, lambda x: '+' || x), chr(10))
         END AS patch FROM (SELECT *, {BASE} AS base, greatest(1, line - 5) AS st, string_split(snippet, chr(10)) AS o,
         string_split(v, chr(10)) AS nw FROM (SELECT *, {ANSWER_SQL} AS v FROM snipped))""", snipped=SNIPPED)


def _answered(s, d):
    prompts = assist.reason_prompts(scanned(s, d))
    return assist.answer(prompts, lambda p: f"Confirmed: {'YES' if 'strcpy' in p else 'NO'}").groupBy(
        "response", "error").agg(F.count("*").alias("n"))


add("answer_hook", _answered,
    f"""SELECT 'Confirmed: ' || CASE WHEN contains(prompt, 'strcpy') THEN 'YES' ELSE 'NO' END AS response,
         NULL::VARCHAR AS error, count(*) AS n FROM ({_prompt_sql(assist.REASON_PROMPT, "snipped", "finding_id")}) GROUP BY ALL""",
    snipped=SNIPPED)
