"""Every query against its SQL on the smallest tables; those without SQL must give rows with values in every column."""

import duckdb
import pytest

from stintlake import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "null" if v != v else f"{v:.5g}" if v else "0"
    return str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    rel = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in columns]
    assert sorted(tuple(map(norm, r)) for r in got.select(columns).collect()) == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_values(spark, name):
    rows = registry.QUERIES[name](spark, SF).toPandas()
    assert len(rows) > 0
    for column in rows:
        found = rows[column].dropna()
        assert len(found) or (name, column) in {("games_needed", "games")}, column
        assert not any(isinstance(v, float) and v in (float("inf"), float("-inf")) for v in found)
