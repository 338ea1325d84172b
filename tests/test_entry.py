"""The entry point: every query runs on the smallest tables, and what has SQL equals it."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not here")


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))  # keeps the sign of zero
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def test_queries_equal_sql(spark):
    import __spark_entry__ as entry
    from lodestack import queries as core

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    sql = entry.oracle_sql()
    for name, f in core.queries().items():
        df = f(spark, DATA)
        got = rows(df.collect(), df.columns)
        if name in sql:
            want = con.execute(sql[name])
            columns = [d[0] for d in want.description]
            assert sorted(columns) == sorted(df.columns), name
            assert got == rows(want.fetchall(), columns), name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plain_keeps_the_sign_of_zero():
    assert plain([-0.0]) != plain([0.0])


def test_entry_without_training_data_subpackage(tmp_path):
    """A copy without the subpackage, its tests and the pipeline, and one that keeps the pipeline."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ask = "import __spark_entry__ as e; from lodestack import queries as c; assert set(e.queries()) == set(c.queries()); assert set(e.oracle_sql()) == set(c.oracle_sql()); print(len(e.queries()))"
    for i, gone in enumerate((("lodestack/llm", "tests/llm", "corpus_pipeline.py"), ("lodestack/llm", "tests/llm"))):
        copy = tmp_path / str(i)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
        for name in gone:
            path = copy / name
            if path.is_dir():
                shutil.rmtree(path)
            elif path.exists():
                path.unlink()
        env = os.environ | {"PYTHONPATH": ""}
        assert int(subprocess.run([sys.executable, "-c", ask], cwd=copy, env=env, check=True, capture_output=True, text=True).stdout) >= 58
