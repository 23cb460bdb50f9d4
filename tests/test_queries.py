"""The queries over the smallest tables, against their SQL."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
import pytest

from lodestone import queries

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the tables are not there")


def rows_of(frame, columns) -> list[tuple]:
    plain = lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, str(TABLES)).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_the_entry_point_needs_no_optional_part(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_optional", list)
    assert set(entry.oracle_sql()) <= set(entry.queries()) == set(queries.queries())
    assert entry.entry(spark).count() > 0
    assert queries.unified_diff(spark, str(TABLES)).count() > 0
