import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from fileloom import queries as own

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def shown(value):
    if isinstance(value, float):
        return round(value, 6)
    return bytes(value) if isinstance(value, bytearray) else value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, sql, sf_dir, name):
    found = entry.queries()[name](spark, sf_dir)
    result = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    want = [tuple(map(shown, row)) for row in result.fetchall()]
    got = [tuple(shown(row[n]) for n in names) for row in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "output_name", "status", "markdown", "size_text"]
    rows = df.collect()
    assert len(rows) == 50 and all(r.status == "done" and r.output_name.endswith(".md") for r in rows)


def test_every_own_query_has_sql():
    assert set(own.QUERIES) == set(own.ORACLE_SQL)


def test_imports_without_llm(tmp_path):
    """Without the subpackage and the pipeline the entry still imports and has the library's own queries."""
    for f in os.listdir(REPO):
        if f not in ("corpus_pipeline.py", ".git"):
            if f == "fileloom":
                os.mkdir(tmp_path / f)
                for g in os.listdir(f"{REPO}/{f}"):
                    if g != "llm":
                        os.symlink(f"{REPO}/{f}/{g}", tmp_path / f / g)
            else:
                os.symlink(f"{REPO}/{f}", tmp_path / f)
    code = "import __spark_entry__ as e; print(len(e.queries()), set(e.queries()) == set(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split() == [str(len(own.QUERIES)), "True"]
