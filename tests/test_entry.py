from __future__ import annotations

import __spark_entry__ as entry_module
import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_core_queries_agree_with_sql(spark):
    from foliospark.plans import registry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("conjunctive_query", "term_first_seen", "extract_metadata", "keep_latest", "storage_flow", "radar_table", "control_read"):
        frame = registry.QUERIES[name](spark, SF)
        columns = sorted(frame.columns)
        want = con.execute(registry.ORACLE[name]).fetchdf()
        assert columns == sorted(want.columns), name
        got = sorted(str(tuple(r)) for r in frame.select(*columns).toPandas().astype(str).itertuples(index=False))
        assert got == sorted(str(tuple(r)) for r in want[columns].astype(str).itertuples(index=False)), name


def test_every_query_has_sql():
    from foliospark.plans import registry

    assert set(registry.QUERIES) == set(registry.ORACLE)
