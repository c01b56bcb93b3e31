"""Every core query with SQL against DuckDB on the smallest tables."""

import os
from pathlib import Path

import pandas as pd
import pytest

from palaver import plans

DATA = os.environ.get("PALAVER_TEST_DATA", "/root/testdata/sf0.001")
SQL = plans.oracle_sql()


def norm(x):
    if hasattr(x, "tolist") and getattr(x, "ndim", 0) > 0 or isinstance(x, (list, tuple)):
        return str([norm(y) for y in x])
    if pd.isna(x):
        return ""
    if type(x).__name__.startswith("bool"):
        return str(bool(x))
    if isinstance(x, (int, float)) or type(x).__name__.startswith(("float", "int")):
        return repr(float(x))
    return str(x)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    a, b = plans.queries()[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = [sorted(tuple(norm(x) for x in r) for r in d[sorted(a.columns)].itertuples(index=False)) for d in (a, b)]
    assert rows[0] == rows[1]


def test_runs_without_the_llm_package(tmp_path):
    """A copy without both llm folders imports, registers the core queries only, and its tests are found."""
    import shutil
    import subprocess
    import sys

    root, copy = Path(__file__).resolve().parent.parent, tmp_path / "copy"
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", ".pytest_cache")
    shutil.copytree(root, copy, ignore=skip)
    assert not (copy / "palaver" / "llm").exists() and not (copy / "tests" / "llm").exists()
    code = "import re, palaver, __spark_entry__ as e; assert palaver.__file__.startswith(%r); q = e.queries(); assert q and 'elo_leaderboard' in q and not [n for n in q if re.match(r'p\\d+_', n)]; assert set(e.oracle_sql()) <= set(q)" % str(copy)
    env = {**os.environ, "PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], check=True, cwd=copy, env=env, capture_output=True)


def test_a_missing_module_inside_llm_is_not_swallowed(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "palaver.llm", None)
    assert entry._llm() is None
    monkeypatch.undo()
    if not (Path(__file__).resolve().parent.parent / "palaver" / "llm").exists():
        return
    for name in [m for m in sys.modules if m.startswith("palaver.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with pytest.raises(ModuleNotFoundError):
        entry._llm()
