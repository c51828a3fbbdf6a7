"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from netsieve.plans.oracles import ORACLES
from netsieve.plans.queries import QUERIES


def plain(rows, columns):
    def cell(x):
        if x is None or x != x:
            return "null"
        return f"{x:.5g}" if isinstance(x, (int, float)) else str(x)

    order = sorted(range(len(columns)), key=lambda k: columns[k].lower())
    return sorted("|".join(cell(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_all_named():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["session_accumulate", "rules_onehot", "perclass_counts", "label_interval_join", "hash_split", "stats15", "matrix1600", "macro_f1", "separation", "cl_flags"])
def test_against_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), names)
