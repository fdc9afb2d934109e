"""Every registered query with a DuckDB twin gives the same rows as it."""

import math
import os

import duckdb
import pytest

from pointloom.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "null" if v is None else f"{v:.6f}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(show(r[i] if not isinstance(r[i], float) or r[i] else 0.0) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    want = duck.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_without_llm(tmp_path):
    """The entry module imports, and the other queries are there, when the llm folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/pointloom", tmp_path / "pointloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'depth_calibration' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(root)]
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(tmp_path), *paths])}

    def run(*args):
        child = subprocess.run([sys.executable, *args], cwd=tmp_path, env=env, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True)
        assert child.returncode == 0, child.stdout[-4000:]
        return child.stdout

    run("-c", code)
    tests = ["-m", "pytest", "-q", "-p", "no:cacheprovider", "--rootdir", str(tmp_path), "tests"]
    found = run(*tests, "--collect-only")
    assert "test_scene.py::test_composite" in found and "tests/llm" not in found
    run(*tests, "-k", "test_entry or (test_query_equals_sql and llff_holdout)")
