"""Every registered query against its SQL twin on DuckDB, at the smallest scale."""

import math

import duckdb
import pytest
from strata.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(rows):
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 4) if isinstance(x, float) else x
    return sorted((tuple(clean(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = norm(tuple(r[c] for c in columns) for r in df.collect())
    found = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert len(got) == len(found)
    for a, b in zip(got, norm(found), strict=True):
        assert all(x == y or (isinstance(x, float) and x == pytest.approx(float(y), abs=2e-4)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0
