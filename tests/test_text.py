"""Text functions: worked cases, and any text against a walk over its characters."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions import text


# text: literals and comments blanked, comments stripped, preprocessor lines stripped, line ends trimmed,
# lines, code lines, includes, functions, text for the call scan. Recorded from a run, then read through.
CASES = [
    ('', '', '', '', '', 1, 0, [], [], ''),
    ('\n', '\n', '\n', '\n', '\n', 2, 0, [], [], '\n'),
    ('x', 'x', 'x', 'x', 'x', 1, 1, [], [], 'x'),
    ('a = "http://a" x;', 'a = "http:       ', 'a = "http:', 'a = "http://a" x;', 'a = "http://a" x;', 1, 1, [], [], 'a = "http:'),
    ('\'"\' y "z"', '\'      z"', '\'"\' y "z"', '\'"\' y "z"', '\'"\' y "z"', 1, 1, [], [], '\'"\' y "z"'),
    ('printf("x" FOO)', 'printf(    FOO)', 'printf("x" FOO)', 'printf("x" FOO)', 'printf("x" FOO)', 1, 1, [], [], 'printf("x" FOO)'),
    ('/* a\n b */ c // d\ne', '    \n      c     \ne', ' c \ne', '/* a\n b */ c // d\ne', '/* a\n b */ c // d\ne', 3, 2, [], [], '\n c \ne'),
    ('"un\nclosed" q', '   \n        q', '"un\nclosed" q', '"un\nclosed" q', '"un\nclosed" q', 2, 2, [], [], '"un\nclosed" q'),
    ('"esc \\" in" x', '            x', '"esc \\" in" x', '"esc \\" in" x', '"esc \\" in" x', 1, 1, [], [], '"esc \\" in" x'),
    ('"line \\\n cont" y', '"line \\\n cont" y', '"line \\\n cont" y', '"line \\\n cont" y', '"line \\\n cont" y', 2, 2, [], [], '"line \\\n cont" y'),
    ('a\u2028b // c\u2028d\ne', 'a\u2028b       \ne', 'a\u2028b \ne', 'a\u2028b // c\u2028d\ne', 'a\u2028b // c\u2028d\ne', 2, 2, [], [], 'a\u2028b \ne'),
    ('tab \t \x0b\x1f\xa0\n end  ', 'tab \t \x0b\x1f\xa0\n end  ', 'tab \t \x0b\x1f\xa0\n end  ', 'tab \t \x0b\x1f\xa0\n end  ', 'tab\n end', 2, 2, [], [], 'tab \t \x0b\x1f\xa0\n end  '),
    ('/**/ x /***/ y /* z', '     x       y /* z', ' x  y /* z', '/**/ x /***/ y /* z', '/**/ x /***/ y /* z', 1, 1, [], [], ' x  y /* z'),
    ('  \n\n  #if A\n#define B \\\n c\n  d', '  \n\n  #if A\n#define B \\\n c\n  d', '  \n\n  #if A\n#define B \\\n c\n  d', '\n\n c\n  d', '\n\n  #if A\n#define B \\\n c\n  d', 6, 4, [], [], '  \n\n\n\n c\n  d'),
    ('#include <a.h>\n# include "b.h"\n#include"c/d.h"', '#include <a.h>\n# include      \n#include       ', '#include <a.h>\n# include "b.h"\n#include"c/d.h"', '\n\n', '#include <a.h>\n# include "b.h"\n#include"c/d.h"', 3, 3, ['a.h', 'c/d.h'], [], '\n\n'),
    ('int f(int a) { if (a) { g(); } }', 'int f(int a) { if (a) { g(); } }', 'int f(int a) { if (a) { g(); } }', 'int f(int a) { if (a) { g(); } }', 'int f(int a) { if (a) { g(); } }', 1, 1, [], ['f'], 'int f(int a) { if (a) { g(); } }'),
    ('😀 /* 😀\n */ \'c\' "😀"', '😀     \n           ', '😀  \'c\' "😀"', '😀 /* 😀\n */ \'c\' "😀"', '😀 /* 😀\n */ \'c\' "😀"', 2, 1, [], [], '😀 \n \'c\' "😀"'),
    ('ctrl \x01 \x02 \x05 /* \x06 */ "\x07"', 'ctrl \x01 \x02 \x05            ', 'ctrl \x01 \x02 \x05  "\x07"', 'ctrl \x01 \x02 \x05 /* \x06 */ "\x07"', 'ctrl \x01 \x02 \x05 /* \x06 */ "\x07"', 1, 1, [], [], 'ctrl \x01 \x02 \x05  "\x07"'),
    ('x \\x \\x \\x \\x \\', 'x \\x \\x \\x \\x \\', 'x \\x \\x \\x \\x \\', 'x \\x \\x \\x \\x \\', 'x \\x \\x \\x \\x \\', 1, 1, [], [], 'x \\x \\x \\x \\x \\'),
]


def blanked(code, opens, ends):
    """Walk the characters: from ``opens`` to its end, all but newlines become blanks. ``ends``
    finds the index behind the end, or None if the piece does not end and so does not open."""
    out, i = [], 0
    while i < len(code):
        end = ends(code, i + len(opens)) if code.startswith(opens, i) else None
        out.append(code[i] if end is None else "".join(c if c == "\n" else " " for c in code[i:end]))
        i = i + 1 if end is None else end
    return "".join(out)


def quote_end(quote):
    def find(code, i):
        while i < len(code):
            if code[i] == quote:
                return i + 1
            if code[i] == "\\" and (i + 1 == len(code) or code[i + 1] == "\n"):
                return None
            i += 2 if code[i] == "\\" else 1
        return None
    return find


def scanned(code):
    steps = [("/*", lambda c, i: c.find("*/", i) + 2 if "*/" in c[i:] else None),
             ("//", lambda c, i: c.find("\n", i) if "\n" in c[i:] else len(c)), ('"', quote_end('"')), ("'", quote_end("'"))]
    for opens, ends in steps:
        code = blanked(code, opens, ends)
    return code


pieces = st.lists(st.sampled_from(['"', "'", "\\", "/*", "*/", "//", "\n", "a", " ", "gets(", ")", "#", "{", ";", "é"]), max_size=25)


def column(spark, texts, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, code string")
    return [tuple(r)[1:] for r in sorted(df.select("i", *exprs).collect())]


def test_cases(spark):
    c = F.col("code")
    got = column(spark, [x[0] for x in CASES], text.neutralize(c), text.strip_comments(c), text.strip_preprocessor(c),
                 text.rstrip_lines(c), text.total_lines(c), text.code_lines(c), text.includes(c), text.functions(c),
                 text.clean_for_calls(c))
    for want, g in zip(CASES, got):
        assert g == want[1:], want[0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(pieces.map("".join), min_size=40, max_size=40))
def test_neutralize_any_text(spark, texts):
    got = column(spark, texts, text.neutralize(F.col("code")), text.scan_text(F.col("code")))
    again = column(spark, [g[0] for g in got], text.neutralize(F.col("code")))
    for t, (plain, marked), (twice,) in zip(texts, got, again):
        assert plain == marked == scanned(t), t
        assert len(plain) == len(t) and all((a == "\n") == (b == "\n") for a, b in zip(plain, t))
        assert all(a in (b, " ") for a, b in zip(plain, t)) and (len(twice) == len(plain))


def test_long_literals_do_not_overflow(spark):
    long = '"' + "a" * 200_000 + '"', '"' + "\\n" * 100_000 + '"', "/*" + "*" * 200_000 + "*/", "'" + "\\x" * 100_000 + "'"
    got = column(spark, [x + " tail" for x in long], text.scan_text(F.col("code")))
    assert all(g == " " * len(x) + " tail" for x, (g,) in zip(long, got))


def test_snippets(spark):
    code = "\n".join(f"l{i}" for i in range(1, 31))
    df = spark.createDataFrame([(code, n) for n in (1, 6, 15, 30, 40)], "code string, line int")
    rows = df.select("line", text.raw_snippet(F.col("code"), F.col("line")).alias("raw"),
                     text.snippet(F.col("code"), F.col("line")).alias("s")).collect()
    lines = code.split("\n")
    for r in rows:
        start, end = max(0, r.line - 6), min(30, r.line + 5)
        assert r.raw == "\n".join(lines[start:end])
        assert (r.s.text, r.s.start_line, r.s.end_line) == (
            "\n".join(f"{i + 1:4d} | {lines[i]}" for i in range(start, end)), start + 1, end)


def test_names(spark):
    got = column(spark, ["C:\\a\\b.c", "x/y/z.cpp", "plain", "a" * 81], text.basename(F.col("code")),
                 text.truncate(F.col("code")), text.escape_html(F.concat(F.col("code"), F.lit("<&>\"'"))))
    assert [g[0] for g in got] == ["b.c", "z.cpp", "plain", "a" * 81]
    assert got[3][1] == "a" * 80 + "..." and got[2][2] == "plain&lt;&amp;&gt;&quot;&#x27;"


def test_strip_ends_only(spark):
    """All characters that ``str.strip`` takes go from both ends, by no pattern over the whole text."""
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert sorted(blanks) == sorted(text.BLANKS)
    values = ["", " ", None, "a", "\u200b a \u200b", "".join(blanks), "x" + "".join(blanks) + "\u00e9"] + [f"{b}a{b}\u4e2d{b}{b}" for b in blanks]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.strip(F.col("v")).alias("s"))
    assert all(r.s == (r.v and r.v.strip()) for r in df.collect())
    assert "regexp_replace" not in df._jdf.queryExecution().toString().lower()
