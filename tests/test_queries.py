"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tallow.plans.registry import ORACLES, QUERIES


def plain(x):
    return "null" if x is None else f"{x:.7g}" if isinstance(x, float) and not math.isnan(x) else str(x)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


#: Fitted by iteration; tested in test_operators and test_heads.
WITHOUT_SQL = {"fold_models", "head_models"}


def test_every_other_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLES)


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = sorted(tuple(map(plain, r)) for r in db.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall())
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    assert got == want
