"""Every registered query against DuckDB on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from weftlog.plans import catalog  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    assert rows
    if name in catalog.ORACLES:
        found = duck.execute(catalog.ORACLES[name])
        order = [d[0] for d in found.description]
        assert sorted(order) == cols
        assert rows == sorted((tuple(norm(r[order.index(c)]) for c in cols) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["run_id", "w_idx", "entity_id", "n_events", "n_types"]
