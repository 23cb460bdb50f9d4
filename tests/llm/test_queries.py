"""The registered queries over the smallest tables, against their SQL where they have one."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
import pytest

from lodestone.llm import registry

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the tables are not there")


def rows_of(frame, columns) -> list[tuple]:
    plain = lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, str(TABLES)).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    out = registry.queries()[name](spark, str(TABLES))
    assert out.count() > 0 and len(set(out.columns)) == len(out.columns)


def test_an_operator_has_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
