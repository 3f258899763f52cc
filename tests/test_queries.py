"""Every registered query of the library against the SQL that states the same result, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from inkwell.plans import queries as own

DIR = entry.SMOKE_DIR


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes, dict)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return round(float(v), 9)
    if type(v).__name__.startswith(("int", "uint", "bool")):
        return int(v)
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    mine = own.queries()[name](spark, DIR).toPandas()
    theirs = duck.sql(own.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(own.queries()) - set(own.oracle_sql())))
def test_runs(spark, name):
    assert own.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_removable_part(tmp_path):
    """A copy without the corpus operators and their pipeline imports and lists its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).resolve().parent
    shutil.copytree(root / "inkwell", tmp_path / "inkwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'newest_first' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
