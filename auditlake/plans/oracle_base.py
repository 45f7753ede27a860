"""DuckDB counterparts of the shared steps, as named common table expressions.

They are written independently of the Spark operators: hits come from splitting at RE2
matches, line numbers from counting the text before a hit, and the merge folds its
findings one by one with their detector names.
"""

from __future__ import annotations

import re

from ..functions import dims
from . import corpus


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    def one(v):
        return lit(v) if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


def newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')))"


def rewrite(t: str, pattern: str, change: str) -> str:
    """Replace matches m of a pattern in t by the expression ``change`` over m."""
    p = lit(pattern)
    return (f"array_to_string(list_transform(list_zip(string_split_regex({t}, {p}), "
            f"list_append(regexp_extract_all({t}, {p}), '')), "
            f"lambda z: z[1] || {change.replace('@m', 'z[2]')}), '')")


BLANK = "regexp_replace(@m, '[^\\n]', ' ', 'g')"
TOKENS_RE2 = (r'/\*[\s\S]*?\*/|//[^\n]*|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"'
              r"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'")
NAMES = sorted({s.function_name for s in dims.SIGNATURES} - {"new", "delete"})
HEAD_RE2 = (r"((?:[)\]]\s*(?:\.|->)\s*)?(?:\b[A-Za-z_]\w*\s*(?:\.|->|::)\s*)*)\b("
            + "|".join(NAMES) + r")\s*\(|\b(?:new|delete)\b")
ARG = r"((?:[^(),]|\([^()]*\))*)"
LEADS = r"\b(?:return|else|do|throw|case|goto|co_return|co_await|co_yield|and|or|not|delete|new)\b"


def _code_files() -> str:
    stm = "[" + ", ".join(lit(s) for s in corpus.STATEMENTS) + "]"
    mods = "[" + ", ".join(lit(s) for s in corpus.MODULES) + "]"
    return f"""
    SELECT '/proj' || (c % 25) || CASE WHEN o % 7 = 0 THEN '/safe_' ELSE '/f_' END || o
             || CASE WHEN o % 5 = 0 THEN '.cpp' WHEN o % 5 = 1 THEN '.h' ELSE '.c' END AS file_path,
           CASE WHEN o % 5 = 0 THEN 'cpp' ELSE 'c' END AS language,
           '#include <' || {mods}[c % {len(corpus.MODULES)} + 1] || '.h>' || chr(10)
             || '#include "m' || (o % 9) || '.h"' || chr(10) || chr(10)
             || 'int run_' || o || '(int n) {{' || chr(10)
             || array_to_string(list_transform(range(0, (o * 3 + c) % 12 + 1), lambda j:
                  '  ' || replace(replace(replace(replace(
                    {stm}[(c * 7 + o * 5 + j * j * 3 + j * 11) % {len(corpus.STATEMENTS)} + 1],
                    '~', chr(10)), '@b', 'b' || ((c + j) % 3)), '@s', 's' || ((o + j * 2) % 3)),
                    '@n', 'n')), chr(10))
             || chr(10) || '}}' || chr(10) AS code,
           c % 25 AS project
    FROM (SELECT o_orderkey AS o, o_custkey AS c FROM orders)"""


def _text_files() -> str:
    return """
    SELECT '/docs/' || source || '/d' || doc_id || '.c' AS file_path, 'c' AS language, text AS code
    FROM documents
    UNION ALL
    SELECT '/pages/p' || page_id || '.cpp', 'cpp', html FROM pages"""


# RE2 has neither look-ahead nor back-references: such rules match their first part here
# and test the text that follows (column g_next); the double-free names are the fixture's.
RE2_RULES = {
    "UAF-001": (r"\bfree\s*\(\s*(\w+)\s*\)\s*;",
                r"NOT regexp_matches(g_next, '^\s*' || regexp_extract(hit, '\(\s*(\w+)', 1) || '\s*=\s*NULL')"),
    "UAF-002": (r"\bfree\s*\(\s*(?:" + "|".join(
        rf"b{i}\s*\)[\s\S]{{0,200}}?\bfree\s*\(\s*b{i}" for i in range(3)) + r")\s*\)", "true"),
    "LEAK-001": (r"(for|while)\s*\([^)]*\)\s*\{[^}]*\bmalloc\s*\([^)]*\)",
                 r"NOT regexp_matches(g_next, '^[^}]*\bfree\s*\(')"),
}
for _n, _f in (("NULL-001", "malloc"), ("NULL-002", "calloc"), ("NULL-003", "realloc")):
    RE2_RULES[_n] = (rf"\b(\w+)\s*=\s*{_f}\s*\([^)]+\)\s*;",
                     r"NOT regexp_matches(g_next, '^\s*if\s*\(\s*' || regexp_extract(hit, '^(\w+)', 1))")


def hits_of(source: str, column: str, pattern: str, keep: str = "file_path, language") -> str:
    p = lit(pattern)
    before = "array_to_string(g[1:k], '') || array_to_string(h[1:k-1], '')"
    return f"""SELECT {keep}, k, h[k] AS hit, g[k+1] AS g_next, 1 + {newlines(before)} AS line,
             {before} AS before
      FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k
            FROM (SELECT {keep}, string_split_regex({column}, {p}) AS g,
                         regexp_extract_all({column}, {p}) AS h FROM {source}))"""


def _rule_hits() -> str:
    parts = []
    for i, r in enumerate(dims.RULES):
        pattern, cond = RE2_RULES.get(r.id, (r.pattern, "true"))
        parts.append(f"SELECT file_path, language, {i} AS dim_idx, line, k, "
                     f"regexp_extract(hit, '\\b(\\w+)\\s*\\(', 1) AS function_name "
                     f"FROM ({hits_of('neutral', 'neut', pattern)}) WHERE {cond}")
    return " UNION ALL ".join(parts)


def _call_hits() -> str:
    p = lit(HEAD_RE2)
    # args need the text up to the closing parenthesis, so the rest of the text is kept
    return f"""
    SELECT *, regexp_extract(before, '[^;{{}}]*$') AS prefix,
           regexp_replace(regexp_extract(hit, {p}, 1), '\\s+', '', 'g') AS receiver,
           coalesce(nullif(regexp_extract(hit, {p}, 2), ''), hit) AS name,
           regexp_extract(rest, '^\\s*{ARG}(?:,\\s*{ARG})?[,)]', ['a', 'b']) AS args
    FROM (SELECT file_path, language, k, h[k] AS hit, g[k+1] AS g_next,
                 array_to_string(g[1:k], '') || array_to_string(h[1:k-1], '') AS before_raw,
                 array_to_string(list_transform(list_zip(g, h)[1:k-1], lambda z: z[1] || z[2]), '') || g[k] AS before,
                 array_to_string(list_transform(list_zip(g[k+1:], list_append(h[k+1:], '')), lambda z: z[1] || z[2]), '') AS rest,
                 1 + {newlines("before")} AS line
          FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k
                FROM (SELECT file_path, language, string_split_regex(lexed, {p}) AS g,
                             regexp_extract_all(lexed, {p}) AS h FROM lexed)))"""


def _matched_calls() -> str:
    return f"""
    SELECT c.file_path, c.language, c.k, c.line, c.name, s.*
    FROM call_hits c JOIN signatures s ON s.sig_language = c.language AND s.sig_name = c.name
    WHERE NOT (c.name NOT IN ('new', 'delete')
               AND regexp_matches(prefix, '^\\s*(?:[A-Za-z_]\\w*[\\s*&]+)+$')
               AND NOT regexp_matches(prefix, {lit(LEADS)}))
      AND NOT CASE WHEN c.language = 'c' THEN regexp_matches(receiver, '(?:\\.|->)$')
                   ELSE regexp_matches(receiver, '^\\w+(?:\\.|->)$') AND NOT regexp_matches(receiver, '^this\\b') END
      AND CASE family
            WHEN 'format' THEN CASE WHEN fmt_arg = 0 THEN trim(args.a) ELSE trim(args.b) END <> ''
              AND NOT CASE WHEN c.language = 'c'
                THEN regexp_matches(CASE WHEN fmt_arg = 0 THEN trim(args.a) ELSE trim(args.b) END,
                     '^[\\s(]*(?:(?:(?:u8|[LuU])?"[^"]*"\\s*)+|[0-9.][\\w.]*)[\\s)]*$')
                ELSE regexp_matches(CASE WHEN fmt_arg = 0 THEN trim(args.a) ELSE trim(args.b) END,
                     '^(?:u8|[LuU])?R?"[^"]*"$') END
            WHEN 'alloc' THEN c.language = 'c' OR NOT regexp_matches(prefix, '\\b(?:if|else)\\b')
            WHEN 'new' THEN NOT contains(regexp_extract(g_next, '^[^;{{}}]*'), 'nothrow')
            ELSE true END"""


RANK = ("CASE {x}.det WHEN 'ast' THEN 3 WHEN 'tree-sitter' THEN 3 WHEN 'regex' THEN 1 ELSE 0 END")


def _spots() -> str:
    boosted = "least(1.0::DOUBLE, greatest(a.conf, x.conf) + 0.15::DOUBLE)"
    better = f"{RANK.format(x='x')} > {RANK.format(x='a')}"
    return f"""
    SELECT file_path, canon_cwe, fn_key, line, list_reduce(list_sort(list(
             {{'seq': seq, 'dim_idx': dim_idx, 'fn': function_name, 'det': detector, 'conf': confidence}})),
             lambda a, x: {{'seq': a.seq,
               'dim_idx': CASE WHEN {better} THEN x.dim_idx ELSE a.dim_idx END,
               'fn': CASE WHEN {better} THEN x.fn ELSE a.fn END,
               'det': CASE WHEN {better} THEN x.det || '+' || a.det
                           WHEN contains(a.det, x.det) THEN a.det ELSE a.det || '+' || x.det END,
               'conf': {boosted}}}) AS s
    FROM raw_findings GROUP BY ALL"""


def _merged() -> str:
    replace = f"({RANK.format(x='x')} > {RANK.format(x='a')} OR x.conf > a.conf)"
    return f"""
    SELECT file_path, canon_cwe, fn_key, list_sort(list(line)) AS lines, list_reduce(list_sort(list(
             {{'seq': s.seq, 'line': line, 'dim_idx': s.dim_idx, 'fn': s.fn, 'det': s.det, 'conf': s.conf}})),
             lambda a, x: {{'seq': a.seq,
               'line': CASE WHEN {replace} THEN x.line ELSE a.line END,
               'dim_idx': CASE WHEN {replace} THEN x.dim_idx ELSE a.dim_idx END,
               'fn': CASE WHEN {replace} THEN x.fn ELSE a.fn END,
               'det': array_to_string(list_sort(list_distinct(string_split(
                        CASE WHEN {replace} THEN x.det ELSE a.det || '+' || x.det END, '+'))), '+'),
               'conf': least(1.0::DOUBLE, CASE WHEN {replace} THEN x.conf ELSE a.conf END + 0.05::DOUBLE)}}) AS s
    FROM spots GROUP BY ALL"""


def _merged_findings() -> str:
    return """
    SELECT file_path, s.line AS line, vuln_type, rule_id, cwe_id, severity, s.conf AS confidence,
           description || CASE WHEN len(lines) > 1
             THEN ' [also on line(s): ' || array_to_string(lines, ', ') || ']' ELSE '' END AS description,
           recommendation, s.det AS detector,
           s.fn AS function_name, s.seq AS seq
    FROM (SELECT *, s.dim_idx AS dim_idx FROM merged) JOIN finding_dim USING (dim_idx)"""


SEVERITY_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
REPORT_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 9 END"


def _findings() -> str:
    return f"""
    SELECT m.* REPLACE (CASE WHEN c.cwe_name IS NOT NULL AND NOT contains(description, c.cwe_name)
             THEN '[' || m.cwe_id || '] ' || c.cwe_name || ' — ' || description ELSE description END AS description)
    FROM merged_findings m LEFT JOIN cwe_dim c ON c.cwe_id = m.cwe_id
    WHERE {SEVERITY_RANK} >= 1"""


def _dims() -> dict[str, str]:
    rows = [(i, r.id, r.name, r.cwe_id, r.severity, dims.RULE_CONFIDENCE, r.description, r.recommendation,
             "regex", r.category, dims.canonical_cwe(r.cwe_id), dims.type_key(r.name))
            for i, r in enumerate(dims.RULES)]
    rows += [(len(dims.RULES) + j, s.rule_id, s.vuln_type, s.cwe_id, s.severity, s.confidence,
              s.description, s.recommendation, s.detector, s.family, dims.canonical_cwe(s.cwe_id),
              dims.type_key(s.vuln_type)) for j, s in enumerate(dims.SIGNATURES)]
    return {
        "finding_dim": values(rows, "dim_idx, rule_id, vuln_type, cwe_id, severity, confidence, "
                              "description, recommendation, detector, category, canon_cwe, type_key"),
        "signatures": values([(len(dims.RULES) + j, s.language, s.function_name, s.family, s.fmt_arg)
                              for j, s in enumerate(dims.SIGNATURES)],
                             "dim_idx, sig_language, sig_name, family, fmt_arg"),
        "cwe_dim": values(dims.CWE_NAMES.items(), "cwe_id, cwe_name"),
        "rules": values([(i, r.id, r.name, r.pattern, r.cwe_id, r.severity, r.description,
                          r.recommendation, r.category, ",".join(r.languages)) for i, r in enumerate(dims.RULES)],
                        "rule_ord, id, name, pattern, cwe_id, severity, description, recommendation, category, languages"),
    }


CTES: dict[str, str] = {
    "code_files": _code_files(),
    "text_files": _text_files(),
    "all_files": "SELECT file_path, language, code FROM code_files UNION ALL SELECT * FROM text_files",
    **_dims(),
    "neutral1": f"SELECT file_path, language, {rewrite('code', '/[*][^*]*[*]+(?:[^/*][^*]*[*]+)*/', BLANK)} AS t FROM code_files",
    "neutral2": f"SELECT file_path, language, {rewrite('t', '//[^\\n]*', BLANK)} AS t FROM neutral1",
    "neutral3": "SELECT file_path, language, " + rewrite("t", r'"(?:[^"\\]|\\[^\n])*"', BLANK) + " AS t FROM neutral2",
    "neutral": "SELECT file_path, language, " + rewrite("t", r"'(?:[^'\\]|\\[^\n])*'", BLANK) + " AS neut FROM neutral3",
    "rule_hits": _rule_hits(),
    "lexed1": "SELECT file_path, language, " + rewrite("code", TOKENS_RE2, (
        "CASE WHEN starts_with(@m, '/') OR @m = '' THEN " + BLANK
        + " ELSE @m[1:1] || regexp_replace(@m[2:-2], '[^\\n]', ' ', 'g') || @m[1:1] END")) + " AS t FROM code_files",
    "lexed": "SELECT file_path, language, " + rewrite("t", r"(?m)^[^\S\n]*#(?:[^\n\\]|\\[\s\S])*", BLANK) + " AS lexed FROM lexed1",
    "call_hits": _call_hits(),
    "matched_calls": _matched_calls(),
    "raw_findings": """
    SELECT r.file_path, r.language, r.line, r.dim_idx, (r.dim_idx * 1000000 + r.k)::BIGINT AS seq, r.function_name,
           d.detector, d.confidence, d.canon_cwe,
           CASE WHEN r.function_name <> '' THEN lower(r.function_name) ELSE d.type_key END AS fn_key
    FROM (SELECT file_path, language, line, dim_idx, k, function_name FROM rule_hits
          UNION ALL
          SELECT file_path, language, line, dim_idx, 1000000000 + k,
                 CASE WHEN name IN ('new', 'delete') THEN '' ELSE name END
          FROM matched_calls) r
    JOIN finding_dim d USING (dim_idx)""",
    "spots": _spots(),
    "merged": _merged(),
    "merged_findings": _merged_findings(),
    "findings": _findings(),
}
# call sites follow all rule hits and keep text order whatever their signature
CTES["raw_findings"] = CTES["raw_findings"].replace(
    "(r.dim_idx * 1000000 + r.k)::BIGINT",
    "CASE WHEN d.detector = 'regex' THEN r.dim_idx * 1000000 + r.k ELSE r.k END::BIGINT")


def q(body: str, **extra: str) -> str:
    """Prefix ``body`` with the common table expressions it needs."""
    known = {**CTES, **extra}
    needed: dict[str, None] = {}

    def visit(sql: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql, re.I):
                visit(known[name])
                needed[name] = None

    visit(body)
    if not needed:
        return body
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({known[n]})" for n in needed) + "\n" + body
