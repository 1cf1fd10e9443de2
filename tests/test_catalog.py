"""Every query of the catalogue that has SQL, against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from marlstone.plans.catalog import ORACLE, QUERIES

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.01")

#: Queries that find nothing in these tables.
EMPTY = ("sql_except", "tql_except", "sql_join_left_is_null", "tql_is_null")


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if isinstance(v, (bool,)) or type(v).__name__ == "bool":
            return bool(v)
        return float(v) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    """Sorts of values by column; numbers of all widths are one."""

    def of(c: pd.Series) -> str:
        seen = {"bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else type(v).__name__ for v in c.dropna()} if c.dtype == object else {"b": {"bool"}, "M": {"time"}}.get(getattr(c.dtype, "kind", "O"), {"number"} if getattr(c.dtype, "kind", "O") in "iuf" else {"str"})
        return "/".join(sorted(seen))

    return {c: of(df[c]) for c in sorted(df.columns)}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.toPandas()
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert len(got) == len(want)
        assert rows(got) == rows(want)
        if len(got):
            assert kinds(got) == kinds(want)
    assert len(got) or name in EMPTY


def test_entry(spark):
    assert entry.entry(spark).columns == ["vec_id", "label", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
