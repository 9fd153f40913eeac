"""Queries that write a drop of files and land it again: Spark's first task writes a file even when it has no rows."""

import pytest

from __spark_entry__ import queries

TABLES = {
    "customer": (
        "id AS c_custkey", "concat('Customer#', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey",
        "CAST(id AS DOUBLE) AS c_acctbal", "IF(id % 5 = 0, 'BUILDING', 'MACHINERY') AS c_mktsegment",
    ),
    "orders": (
        "id AS o_orderkey", "id AS o_custkey", "IF(id % 2 = 0, 'F', 'O') AS o_orderstatus", "CAST(id AS DOUBLE) AS o_totalprice",
        "TIMESTAMP_NTZ'1998-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    ),
    "events": (
        "id AS event_id", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(CAST(id / 150 AS INT)) AS ts", "id AS user_id",
        "'view' AS event_type", "CAST(id AS DOUBLE) AS value", "'{}' AS props",
    ),
}
DROPPED = {
    "landing_claims": "events",
    "multi_path_union": "orders",
    "custom_parser": "customer",
    "json_array_source": "customer",
    "jsonl_source": "customer",
}


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", sorted(DROPPED))
def test_drops_hold_no_blank_files(spark, tmp_path, small_splits, name):
    table = f"{tmp_path}/{DROPPED[name]}.parquet"
    spark.range(4000).selectExpr(*TABLES[DROPPED[name]]).coalesce(1).write.parquet(table)
    # The row group belongs to the split in its middle.
    assert spark.read.parquet(table).rdd.glom().map(len).first() == 0
    rows = queries()[name](spark, str(tmp_path))
    assert rows.count() == 4000 and rows.exceptAll(spark.read.parquet(table)).isEmpty()
