"""Every catalog query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from prismlake.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "part lineitem events embeddings pages".split()


def same(d: pd.DataFrame) -> list:
    d = d[sorted(d.columns)].astype(object)
    return sorted(tuple("" if pd.isna(x) else repr(float(x)) if isinstance(x, (int, float)) else str(x) for x in r) for r in d.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert same(got) == same(want)


def test_compare_global_data_where_padded_sections_agree_by_chance(spark, tmp_path):
    """Sections of two and more images, padded to 30 bytes, are equal where the third image begins with zeros."""
    keys = [k for k in range(0, 7_000_000, 14 * 37) if k % 3 == 1 and (k + 74) % 33 == 0 and ((k * 3 + 22) % 97 == 0 or k < 200_000)]
    spark.createDataFrame([(k, k % 50 + 1) for k in keys], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got, want = QUERIES["compare_global_data"](spark, str(tmp_path)).toPandas(), con.sql(ORACLES["compare_global_data"]).df()
    assert same(got) == same(want)
    raw = set(want[want.path == "raw_payload"].texture_id)
    assert 195286 in keys and 195286 not in raw
    assert raw
