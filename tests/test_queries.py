"""Every registered query of the core against its SQL, on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from trellis import queries as core

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}/*.parquet" if os.path.isdir(f"{DATA}/{f}") else f"{DATA}/{f}"
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return c


def rows(df):
    show = lambda v: "null" if v is None or v is pd.NaT or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted("|".join(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query(spark, tables, name):
    got, want = core.QUERIES[name](spark, DATA).toPandas(), tables.execute(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert core.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["entry_no", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_subpackage():
    import pathlib
    import trellis

    root = pathlib.Path(trellis.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "trellis.llm" not in path.read_text()
