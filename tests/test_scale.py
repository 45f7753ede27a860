"""Work is done once, spread, and leaves no more on disk than it needs."""

import os

from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.operators import analyze, calls, detect, merge
from auditlake.plans import corpus, queries
from auditlake.session import checkpoint_folder, numbered
from test_merge import PROGRAM


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def passes(spark, folder, n=40):
    """n rows whose making leaves one line each in a file of ``folder``."""
    def run(batches):
        for batch in batches:
            with open(f"{folder}/{os.getpid()}", "a") as out:
                out.write("x\n" * len(batch))
            yield batch

    severities = F.element_at(F.array(F.lit("low"), F.lit("critical"), F.lit("high")), (F.col("id") % 3 + 1).cast("int"))
    rows = spark.range(n).select(F.concat(F.lit("/f"), F.col("id").cast("string")).alias("file_path"), severities.alias("severity"),
                                 F.col("id").cast("int").alias("line"), F.lit(0).alias("seq"))
    return rows.mapInPandas(run, rows.schema)


def made(folder):
    return sum(len((folder / f).read_text().split()) for f in os.listdir(folder))


def test_numbering_works_rows_out_once(spark, tmp_path):
    got = numbered(passes(spark, str(tmp_path)), merge.report_keys(), "number").orderBy("number").collect()
    assert made(tmp_path) == 40
    assert [r.number for r in got] == list(range(1, 41))
    assert [r.severity for r in got] == ["critical"] * 13 + ["high"] * 13 + ["low"] * 14


def test_report_order_works_rows_out_once(spark, tmp_path):
    got = merge.report_order(passes(spark, str(tmp_path))).collect()
    assert made(tmp_path) == 40
    assert [(r.severity, r.file_path) for r in got] == sorted(((r.severity, r.file_path) for r in got), key=lambda x: (
        ["critical", "high", "low"].index(x[0]), x[1]))


def test_folds_are_worked_out_once(spark, files_of):
    files = files_of(a=PROGRAM, b="gets(x);\ngets(y);")
    whole = plan(merge.scan(files)).count("regexp_replace")
    for df in (merge.collapse_per_file(files).select("file_path", F.array_join(F.col("lines").cast("array<string>"), ",")),
               merge.merge_same_spot(files).select("file_path", "rule_id")):
        assert 0 < plan(df).count("regexp_replace") <= whole


def test_arriving_files_are_spread(spark, sf, tmp_path):
    seen = []
    stream = corpus.arriving_files(spark, sf).writeStream.foreachBatch(lambda batch, k: seen.append(batch.rdd.getNumPartitions()))
    stream.option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert seen and min(seen) >= 4


def test_trees_are_written_and_removed_by_many_tasks(spark, sf, monkeypatch):
    tasks, whole = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, f, schema, *a: (
        tasks.append(df.rdd.getNumPartitions()) if schema == "n bigint" else None, whole(df, f, schema, *a))[1])
    assert queries._listed(spark, sf).count() > 0
    assert len(tasks) == 2 and min(tasks) >= 4


def test_trees_are_removed_once_listed(spark, sf, monkeypatch):
    whole = {r.path for r in queries._listed(spark, sf).collect()}
    sizes, write = [], corpus.write_tree
    monkeypatch.setattr(corpus, "write_tree", lambda part, root: (sizes.append(part.count()), write(part, root)))
    monkeypatch.setattr(queries, "FILES_AT_ONCE", 500)
    here = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(here))
    assert {r.path for r in queries._listed(spark, sf).collect()} == whole
    assert len(sizes) == 4 and max(sizes) < 600
    new = [f"{here}/{n}" for n in set(os.listdir(here)) - before if n.startswith("tree-")]
    assert len(new) == 1 and not any(f.startswith("f") for _, _, names in os.walk(new[0]) for f in names)


def test_call_names_are_found_once(spark, files_of):
    files = files_of(a=PROGRAM, b="gets(x);\nchar *p = new char[3]; delete p;")
    for df in (calls.call_sites(files), merge.scan(files)):
        assert plan(df).count("^(new|delete)") == 1
        assert plan(df).count(r"(\w+)\s*$, 1") == 1


def test_rule_hits_are_counted_where_they_stand(spark, files_of):
    files = files_of(a=PROGRAM, b="gets(x);\ngets(y); free(p); free(p);")
    placed = {r.dim: r.n for r in detect.rule_findings(files).groupBy("dim").agg(F.count("*").alias("n")).collect()}
    counts = detect.rule_counts(files)
    assert {r.dim: r.n for r in counts.collect()} == placed and len(placed) > 3
    assert "explode" not in plan(counts) and detect.rule_counts(files.limit(0)).collect() == []


def test_bound_values_are_not_copied():
    """What ``transform`` gives is copied, so a value bound through it was copied at every level."""
    assert "transform(array(" not in str(text.let(F.col("a"), lambda x: F.struct(x, x)))


def test_counts_leave_texts_out(spark, files_of):
    files = files_of(a=PROGRAM, b="gets(x);\ngets(y);\nint n;")
    slim = merge.scan_files(files, fields=("severity",))
    assert analyze.fields_of(slim) == ["rank", "line", "seq", "severity"]
    pick = lambda df: sorted((r.file_path, r.line, r.seq, r.severity) for r in merge.findings_of(df).collect())
    assert pick(slim) == pick(merge.scan_files(files)) and len(pick(slim)) > 3
    assert "also on line(s)" in plan(merge.scan_files(files)) and "also on line(s)" not in plan(slim)


def test_lines_of_few_and_of_many_hits(spark, files_of):
    for n in range(10):
        lines = [f"gets(a); printf(b{i}); /* é\n */" for i in range(n)]
        found = detect.rule_findings(files_of(a="\n".join(["int x;", *lines]))).collect()
        assert sorted((r.dim, r.line) for r in found if r.function_name in ("gets", "printf")) == sorted(
            (dim, 2 + 2 * i) for dim in (0, 7) for i in range(n))
