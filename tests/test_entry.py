"""The driver contract: queries against their SQL on the smallest tables, where those are here."""

import os
import subprocess
import sys

import pandas as pd
import pytest

import __spark_entry__ as entry
from drawstats import catalog

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_part(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", ".git", "drawstats"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    (tmp_path / "drawstats").mkdir()
    for name in os.listdir(f"{root}/drawstats"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/drawstats/{name}", tmp_path / "drawstats" / name)
    code = "import __spark_entry__ as e; assert e.llm_queries is None; q = e.queries(); assert 'draws' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if pd.isna(v):
            return "~"
        return str(v) if isinstance(v, (str, bool)) or type(v).__name__ == "bool_" else f"{float(v) + 0.0:.6f}"

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.exists(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    got = catalog.QUERIES[name](spark, DATA).toPandas()
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    want = con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
