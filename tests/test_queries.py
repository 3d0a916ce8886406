"""Every core query against its oracle over the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from scholia.plans import catalog

Q, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(df):
    def text(x):
        if isinstance(x, float):
            return "null" if x != x else f"{x:.6g}"
        if x is None or x is pd.NaT or x is pd.NA:
            return "null"
        if isinstance(x, pd.Timestamp) or hasattr(x, "isoformat"):
            return str(pd.Timestamp(x).tz_localize(None))
        return f"{float(x):.6g}" if hasattr(x, "dtype") and x.dtype.kind == "f" else str(x)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_oracle(spark, sf, con, name):
    got, want = Q[name](spark, sf).toPandas(), con.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, sf, name):
    assert Q[name](spark, sf).count() > 0


def test_the_rest_does_without_the_text_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(catalog.__file__)))
    for p in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in p:
            with open(p) as f:
                assert "scholia.llm" not in f.read(), p
