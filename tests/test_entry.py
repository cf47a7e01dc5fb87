"""The entry module with and without the folders that may be absent, and every query that has SQL."""

from __future__ import annotations

import ast
import math
import os
import subprocess
import sys

import pytest

import __spark_entry__
from phenospark.plans import queries as plans

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(values):
    def norm(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(round(float(v), 9) + 0.0)
        try:
            return repr(round(float(v), 9) + 0.0) if not isinstance(v, (str, bool)) else str(v)
        except TypeError:
            return str(v)

    return sorted(tuple(map(norm, r)) for r in values)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cur = duck.execute(plans.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = rows([tuple(r[cols.index(c)] for c in order) for r in cur.fetchall()])
    assert rows([tuple(r[c] for c in order) for r in df.collect()]) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_keys_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_separate_package():
    for d, _, names in os.walk(os.path.join(ROOT, "phenospark")):
        if os.path.basename(d) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                tree = ast.parse(open(os.path.join(d, n)).read())
                for node in ast.walk(tree):
                    mods = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in m.split(".") for m in mods), n


def test_entry_imports_without_the_separate_package():
    import shutil
    import tempfile

    code = """
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op1") for n in e.queries()) and "pipeline" not in e.queries() and e.oracle_sql()
"""
    with tempfile.TemporaryDirectory() as copy:
        shutil.copytree(os.path.join(ROOT, "phenospark"), os.path.join(copy, "phenospark"), ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)


def test_a_separate_package_that_fails_takes_nothing_else_along(tmp_path):
    import shutil

    shutil.copytree(os.path.join(ROOT, "phenospark"), tmp_path / "phenospark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "phenospark" / "llm").mkdir()
    (tmp_path / "phenospark" / "llm" / "__init__.py").write_text("raise ImportError('broken on purpose')")
    (tmp_path / "corpus_pipeline.py").write_text("from phenospark.llm import packing")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 100"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0 and "broken on purpose" in done.stderr
