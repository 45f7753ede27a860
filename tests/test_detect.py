"""Rules and call sites: against Python's ``re`` on all derived files, and small cases."""

import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditlake.functions import dims
from auditlake.operators import calls, detect, merge
from auditlake.plans import corpus
from test_text import scanned


def test_all_rules_equal_python_re(spark, sf):
    files = corpus.code_files(spark, sf).select("file_path", "language", "code")
    expected = Counter()
    for f in files.collect():
        clean = scanned(f.code)
        for rule in dims.RULES:
            for m in re.finditer(rule.pattern, clean):
                fn = re.search(r"\b(\w+)\s*\(", m.group(0))
                expected[(f.file_path, rule.id, clean[:m.start()].count("\n") + 1, fn.group(1) if fn else "")] += 1
    found = detect.scan_rules(files).select("file_path", "rule_id", "line", "function_name").collect()
    assert Counter(map(tuple, found)) == expected
    assert len({k[1] for k in expected}) == 24  # BOF-005 needs a quote, which is always blank


def test_rule_cases(spark, files_of):
    cases = {
        'printf("x" FOO);': ["FMT-001"], "free(p); p = NULL;": [], "free(p);\n p = NULL;": [], "free(p); q = NULL;": ["UAF-001"],
        "x = malloc(n);\n if (x)": [], "x = malloc(n);": ["NULL-001"], 's = "gets(x)"; // gets(y)': [],
        "égets(x);": [], "printf(größe);": ["FMT-001"], "free(a);" + " " * 199 + "free(a)": ["UAF-001", "UAF-002"],
        "free(a);" + " " * 200 + "free(a)": ["UAF-001"], "while (1) { p = malloc(4); free(p); }": ["UAF-001"],
        "char\nb\n[ 4 ] ;": ["UNINIT-001"], "a\u2028gets(b)": ["BOF-001"],
    }
    files = files_of(**{f"f{i}": t for i, t in enumerate(cases)})
    found = {}
    for r in detect.scan_rules(files).collect():
        found.setdefault(r.file_path, []).append(r.rule_id)
    for i, want in enumerate(cases.values()):
        assert sorted(set(found.get(f"/t/f{i}.c", [])) - ({"NULL-001"} - set(want))) == want, i


def test_bad_and_gated_rules(spark, files_of):
    pack = [dims.Rule("A", "broken", "(", "CWE-1", "low", "", ""),
            dims.Rule("B", "cpp only", "x+", "CWE-1", "low", "", "", languages=("cpp",))]
    got = detect.scan_rules(files_of(a="xx x", b_cpp="x y xx"), pack).collect()
    assert [(r.rule_id, r.file_path) for r in got] == [("B", "/t/b_cpp.cpp")] * 2


def flagged(files):
    return sorted((r.rule_id, r.line) for r in calls.matched_calls(files).collect())


def test_call_arguments_at_any_depth(spark, files_of):
    deep = "(" * 40 + "a, b" + ")" * 40
    got = calls.call_sites(files_of(a=f'void f(void) {{ g(x, h(1, k(2, 3)), "p,q)", {deep}); e(); m(a[1], (b, c)); }}')).collect()
    args = {r.function_name: r.args for r in got}
    assert args["g"] == ["x", "h(1, k(2, 3))", '"    "', deep]
    assert args["h"] == ["1", "k(2, 3)"] and args["k"] == ["2", "3"] and args["e"] == [] and args["m"] == ["a[1]", "(b, c)"]


def test_call_cases(spark, files_of):
    c = files_of(a="\n".join([
        "char *gets(char *s);", "int main() {", "gets(b);", 'printf("a" "b"); printf(fmt); printf(("x")); printf();',
        'fprintf(f, "x"); fprintf(f(1, 2), s); fprintf(f);', 'syslog(LOG_ERR, "x"); syslog(3, x);', "o.strcpy(a); o->p.strcat(a);",
        "return malloc(4); }", "#define X gets(b)", "/* gets(b) */ sscanf(b, c); system(d);", "memcpy(a, b, c); if (p = calloc(1, 2)) x();"]))
    assert flagged(c) == sorted([
        ("AST-BOF-gets", 3), ("AST-FMT-printf", 4), ("AST-FMT-fprintf", 5), ("AST-FMT-syslog", 6), ("AST-NULL-malloc", 8),
        ("AST-INP-sscanf", 10), ("AST-CMD-system", 10), ("AST-NULL-calloc", 11)])
    cpp = files_of(a_cpp="\n".join([
        "void f() {", 'gets(b); printf("a" "b"); printf("a"); std::system(x);', "o.strcpy(a); o->p.strcat(a); this->sprintf(a);",
        "if (c) p = malloc(1);", "p = realloc(p, 2);", "q = new int[3]; r = new (std::nothrow) int;", "delete q; delete[] r; }",
        "struct S { S() = delete; void *operator new(size_t); void operator delete(void *p); };", 's = "http://x"; popen(a, b);',
        'auto t = R"(gets(x); " )"; scanf("%s", b);']))
    assert flagged(cpp) == sorted([
        ("TS-BOF-gets", 2), ("TS-FMT-printf", 2), ("TS-CMD-system", 2), ("TS-BOF-strcat", 3), ("TS-BOF-sprintf", 3),
        ("TS-NULL-realloc", 5), ("TS-CPP-NEW", 6), ("TS-CPP-DEL", 7), ("TS-CPP-DEL", 7), ("TS-CMD-popen", 9)])


def test_literal_lookup_equals_signature_join(spark, sf):
    files = corpus.code_files(spark, sf).select("file_path", "language", "code")
    joined = Counter((r.file_path, r.rule_id, r.line) for r in calls.matched_calls(files).collect())
    slim = detect.describe(calls.call_findings(files), dims.finding_dim(spark)).collect()
    assert Counter((r.file_path, r.rule_id, r.line) for r in slim) == joined
    both = merge.detect_all(files).groupBy((F.col("detector") == "regex").alias("rule")).count().collect()
    assert {r.rule: r["count"] for r in both}[False] == sum(joined.values())


def test_rule_dialects(spark, files_of):
    from auditlake.functions import dims

    assert dims.java_dialect(r"(?P<a_b>x)(?P=a_b)\Z \\Z \(?P<q>") == r"(?<abx>x)\k<abx>\z \\Z \(?P<q>"
    pack = [dims.Rule("N", "named", r"(?P<my_f>gets)\s*\(", "CWE-1", "low", "d", ""), dims.Rule("B", "broken", "(", "CWE-1", "low", "d", ""),
            dims.Rule("C", "conditional", r"(a)?(?(1)b|c)", "CWE-1", "low", "d", ""), dims.Rule("Z", "end", r"end\Z", "CWE-1", "low", "d", "")]
    with pytest.warns(UserWarning, match="rule [BC] is left out"):
        got = detect.scan_rules(files_of(a="gets(x);\nend\nend"), pack).collect()
    assert sorted((r.rule_id, r.line) for r in got) == [("N", 1), ("Z", 3)]


def test_many_calls_in_one_statement(spark, files_of):
    code = "int f() { x = " + " + ".join(f"g{i}(a, {i})" for i in range(20_000)) + "; }"
    got = calls.call_sites(files_of(a=code)).selectExpr("count(*) AS n", "max(size(args)) AS a").first()
    assert got.n == 20_000 and got.a == 2


def test_nested_calls_in_linear_time(spark, files_of):
    """Ten thousand levels: each bracket is paired once."""
    depth = 10_000
    code = "int f() { printf(" + "g(" * depth + "fmt, 1" + ")" * depth + ", x); }"
    started = time.perf_counter()
    got = calls.matched_calls(files_of(a=code)).collect()
    assert [(r.rule_id, len(r.args)) for r in got] == [("AST-FMT-printf", 2)] and got[0].args[1] == "x"
    assert time.perf_counter() - started < 60
    some = calls.call_sites(files_of(a="x = " + "g(a, " * 300 + "b" + ")" * 300 + ";")).select("args").collect()
    assert len(some) == 300 and all(len(r.args) == 2 for r in some) and {r.args[0] for r in some} == {"a"}
    odd = calls.call_sites(files_of(a="f(a, (b, c); g(h(1), 2 ; k) m(3, n(4))")).collect()
    assert {r.function_name: r.args for r in odd} == {"f": ["a", "(b, c)"], "g": ["h(1)", "2"], "h": ["1"], "m": ["3", "n(4)"], "n": ["4"]}


def test_running_sums_and_runs(spark):
    from auditlake.functions.arrays import running, runs

    rows = [([],), ([5],), (list(range(-9, 40)),), ([1] * 1000,)]
    df = spark.createDataFrame(rows, "v array<bigint>")
    for r in df.select("v", running(F.col("v")).alias("s"), runs(F.col("v"), lambda a, x: x > a, lambda run: F.size(run)).alias("n")).collect():
        assert r.s == [sum(r.v[:i + 1]) for i in range(len(r.v))]
        assert sum(r.n) == len(r.v) and len(r.n) == (len(r.v) and 1 + sum(x > a for a, x in zip(r.v, r.v[1:])))
