"""Every registered query with SQL gives DuckDB's rows; the package works without the optional part."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from rectpart.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.values.tolist()), key=str)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_sql(spark, con, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_geometric_mean_of_the_whole_column(spark, con):
    got = catalog.queries()["geometric_mean_column"](spark, SF).first().geomean
    assert got == pytest.approx(con.execute("SELECT exp(avg(ln(l_quantity))) FROM lineitem").df().iloc[0, 0], rel=1e-9)


def test_without_the_optional_part(tmp_path):
    """A copy without the folder, and without what stands on it, gives the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/rectpart", tmp_path / "rectpart", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=tmp_path, env=env)
    assert said.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql())), "False"], said.stderr
