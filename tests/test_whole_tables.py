"""Queries that must answer for every row of their table."""

import duckdb

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_visible_highlights_of_every_group(spark):
    got = {r.g for r in catalogue.QUERIES["visible_highlights"](spark, SF).collect()}
    wanted = duckdb.sql(f"SELECT DISTINCT l_partkey FROM '{SF}/lineitem.parquet' JOIN '{SF}/orders.parquet' ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'").fetchall()
    assert got == {g for g, in wanted} and max(got) >= 100


def test_dup_groups_exact_lists_every_file(spark, tmp_path):
    rows = [(i, f"text {i % 2}" if i < 15 else None, "en", "web", 100 + i) for i in range(18)] + [(99, "alone", "en", "web", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.QUERIES["dup_groups_exact"](spark, str(tmp_path))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = duckdb.sql(catalogue.SQL["dup_groups_exact"]).select(*df.columns).fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert sorted(len(r[df.columns.index("paths")].split(",")) for r in got) == [3, 7, 8]
