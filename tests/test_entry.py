"""The driver's contract."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p3_found", "p5_found"} <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_small_oracles(spark):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name in ("p5_found", "latest_version_per_item", "related_events_top4", "item_versioning", "canonical_urls", "facet_counts_all", "search_membership"):
        a = entry.queries()[name](spark, DATA)
        b = c.sql(entry.oracle_sql()[name])
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        row = lambda rs, names: sorted(str([r[names.index(k)] for k in cols]) for r in rs)
        assert row([tuple(r) for r in a.collect()], a.columns) == row(b.fetchall(), b.columns), name
    assert entry.entry(spark).count() > 0
