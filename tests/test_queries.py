"""Every registered catalogue query against its DuckDB SQL, and each again with another number of partitions."""

import math

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "tzinfo") and hasattr(v, "hour"):
        return v.replace(tzinfo=None)
    return round(float(v), 9) if type(v).__name__ == "Decimal" else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    wanted = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_partitions_do_not_matter(spark, name):
    first = catalogue.QUERIES[name](spark, SF)
    before = rows(first.columns, first.collect())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    again = catalogue.QUERIES[name](spark, SF)
    assert rows(again.columns, again.collect()) == before and before
    spark.conf.set("spark.sql.shuffle.partitions", "4")
