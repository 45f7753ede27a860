"""Folder source, table source, sinks and the stream."""

import json

from pyspark.sql import functions as F

from auditlake.operators import analyze, merge
from auditlake.sources import files as src
from auditlake.sources import sinks
from auditlake.streaming.scan_stream import read_arriving, scan_stream
from test_merge import PROGRAM


def tree(root):
    for name, data in {"a.c": PROGRAM.encode(), "sub/B.CPP": b"gets(x);\r\ny\rz", "sub/c.txt": b"gets(x)", "build/d.c": b"gets(x);",
                       "bad.h": b"ok \xff\xef\xbf\xbd end", "empty.c": b"", "sub/.c": b"x", ".git/e.c": b"x", "_fixed/a.c": b"gets(q);"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def test_load_folder_and_file(spark, tmp_path, monkeypatch):
    root = tmp_path / "build"  # a skipped name above the root does not count
    tree(root)
    for name in ("_b.c", ".c1.c", "_internal/d.c", ".hid/e.c", "sp ace.c", "_internal/empty.h", "dist/no.c", "_internal/_fixed/no.c"):
        (root / name).parent.mkdir(exist_ok=True, parents=True)
        (root / name).write_bytes(b"" if "empty" in name else name.encode())
    want = {"a.c": ("c", PROGRAM), "sub/B.CPP": ("cpp", "gets(x);\ny\nz"), "bad.h": ("c", "ok \ufffd end"), "empty.c": ("c", ""),
            "_b.c": ("c", "_b.c"), ".c1.c": ("c", ".c1.c"), "_internal/d.c": ("c", "_internal/d.c"), ".hid/e.c": ("c", ".hid/e.c"),
            "sp ace.c": ("c", "sp ace.c"), "_internal/empty.h": ("c", "")}
    monkeypatch.chdir(root)
    for path in (str(root), f"{root}/", root.as_uri()):
        got = {r.file_path[len(str(root)) + 1:]: (r.language, r.code) for r in src.load_files(spark, path).collect()}
        assert got == want, path
    one = src.load_files(spark, str(root / "sub" / "B.CPP")).collect()
    assert [r.language for r in one] == ["cpp"]
    assert src.errors(src.load_files(spark, str(root))).count() == 0


def test_unreadable_files_are_rows(spark, tmp_path):
    root = tmp_path / "in"
    tree(root)
    (root / "dead.c").symlink_to(root / "nowhere.c")
    (root / "loop").symlink_to(root)
    (root / "sub" / "big.c").write_bytes(b"gets(a);" * 500)
    (root / "deep" / "er").mkdir(parents=True)
    (root / "deep" / "er" / "z.h").write_text("gets(z);")

    def store(uri):
        if uri.endswith("/er"):
            raise PermissionError("not allowed here")
        return src.open_store(uri)

    files = src.load_files(spark, str(root), store=store, most=3000)
    got = {r.file_path[len(str(root)) + 1:]: r.error for r in src.errors(files).collect()}
    assert set(got) == {"dead.c", "sub/big.c", "deep/er"}
    assert "larger than 3000 bytes" in got["sub/big.c"] and "not allowed here" in got["deep/er"] and got["dead.c"].startswith(f"{root}/dead.c: ")
    assert {r.file_path.rsplit("/", 1)[1] for r in src.valid(files).collect()} == {"a.c", "B.CPP", "bad.h", "empty.c"}
    assert merge.scan(files).select("file_path").distinct().count() == 2
    summary = analyze.summary(merge.scan_files(files), str(root)).first()
    assert (summary.files_scanned, summary.files_with_issues) == (7, 2)
    gone = src.load_files(spark, str(tmp_path / "gone.c")).collect()
    assert len(gone) == 1 and gone[0].code is None and "no such file" in gone[0].error
    assert src.load_files(spark, str(root / "sub" / "c.txt")).count() == 0


def test_errors_and_tables(spark):
    t = spark.createDataFrame([("x/a.H", "b\r\nc"), ("y.hh", None)], "p string, t string")
    f = src.from_table(t, "p", "t")
    assert [(r.language, r.code) for r in src.valid(f).collect()] == [("c", "b\nc")]
    assert [r.error for r in src.errors(f).collect()] == ["y.hh: no text"]


def test_json_and_fixed_files(spark, files_of, tmp_path):
    files = files_of(p=PROGRAM)
    findings = merge.scan(files)
    docs = [json.loads(r.json) for r in sinks.finding_json(findings).collect()]
    assert list(docs[0]) == sinks.FINDING_FIELDS and docs[0]["llm_confirmed"] is None and docs[0]["column"] == 0
    sinks.write_report(findings, analyze.severity_counts(findings), src.errors(files), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "findings")).count() == 4
    fixed = spark.createDataFrame([("/x/a.c", "1"), ("/x/b.c", "2")], "file_path string, fixed_code string")
    assert sorted(r.out_path for r in sinks.with_out_path(fixed, "/o").collect()) == ["/o/a.c", "/o/b.c"]
    clash = fixed.union(spark.createDataFrame([("/y/a.c", "3")], fixed.schema))
    assert sorted(r.out_path for r in sinks.with_out_path(clash, "/o/").collect()) == ["/o/x/a.c", "/o/x/b.c", "/o/y/a.c"]
    status = {r.filename: r.status for r in sinks.publish(fixed, fixed.where("file_path = '/x/a.c'").withColumn("code", F.lit(""))).collect()}
    assert status == {"a.c": "applied", "b.c": "error"}


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    tree(folder)
    (folder / "_h.c").write_text("gets(h);")
    def run():
        scan_stream(read_arriving(spark, str(folder), str(tmp_path / "names")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return {(r.file_path, r.rule_id, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = lambda: {(r.file_path, r.rule_id, r.line) for r in merge.scan(src.load_files(spark, str(folder))).collect()}
    assert run() == batch()
    (folder / "late.c").write_text("strcpy(a, b);")
    (folder / ".hid").mkdir()
    (folder / ".hid" / "x.c").write_text("system(a);")
    assert run() == batch()
    # nothing new: no batch; a batch that runs again replaces its own output
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert run() == batch() and sorted(p.name for p in (tmp_path / "out").iterdir()) == before
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    rows = spark.read.parquet(str(tmp_path / "out")).count()
    assert run() == batch() and spark.read.parquet(str(tmp_path / "out")).count() == rows


def test_seq_pairs_nearest_partner(spark, files_of):
    free = r"\bfree\s*\(\s*(\w+)\s*\)"
    got = analyze.seq_pairs(files_of(a="free(a);free(b);free(a);free(a);" + " " * 300 + "free(b)"), free, free, 20, True).collect()
    assert sorted((r.arg, r.first_start, r.second_start) for r in got) == [("a", 0, 16), ("a", 16, 24)]
