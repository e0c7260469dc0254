"""Every named query against its SQL twin, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
DIR = "/root/testdata/sf0.001"
# the feature guards depend on the row count; this SQL assumes at least 10,000 rows
LARGER = {n: "/root/testdata/sf0.01" for n in ("engineered_features", "engineered_profiles", "profile_windows",
                                               "tree_truth", "stump_attribution")}


def comparable(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None or isinstance(value, (str, datetime.datetime)):
        return value
    if isinstance(value, (int, float)):
        return "inf" if math.isinf(value) else float(value)
    return tuple(map(comparable, value))


def key(row):
    return tuple((x is None, str(type(x)), 0 if x is None else x) for x in row)


@pytest.fixture(scope="module")
def duck():
    links = {}
    for d in {DIR, *LARGER.values()}:
        links[d] = duckdb.connect()
        for t in TABLES:
            links[d].execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return links


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 90


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    d = LARGER.get(name, DIR)
    df = entry.queries()[name](spark, d)
    columns = sorted(df.columns)
    got = sorted((tuple(comparable(r[c]) for c in columns) for r in df.collect()), key=key)
    cursor = duck[d].execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    spots = [names.index(c) for c in columns]
    want = sorted((tuple(comparable(r[i]) for i in spots) for r in cursor.fetchall()), key=key)
    assert got == want


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
