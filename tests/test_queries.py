"""A sample of the registered queries beside their DuckDB SQL; check_oracle.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from auditlake.plans.queries import ORACLES, QUERIES

SAMPLE = ["scan_findings", "scan_rules", "call_sites", "file_metadata", "bench_metrics", "fix_file", "seq_pairs",
          "apply_verdicts", "report_rows", "scan_bad_rule", "project_info", "snippet_splice",
          "try_template_fix", "src_errors", "answer_hook", "txt_basename", "fix_publish", "scan_lang_gate", "join_fix_original"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("orders", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    assert mine == sorted(repr(tuple(dict(zip(names, r))[c] for c in columns)) for r in cur.fetchall())


def test_registry(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(queries)
    assert entry.entry(spark).count() > 0
