import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from meshlens.plans import catalog_queries


@pytest.mark.parametrize("first", [0, 65_530, 9_999_990, (1 << 33) - 5])
def test_subnets_of_events_and_users_beyond_four_hex_digits(spark, first):
    """An address was no address from event or user 65,536 on."""
    users = F.when(F.col("id") % 7 == 0, F.lit(5)).when(F.col("id") % 7 == 1, F.lit(17)).when(F.col("id") % 7 == 2, F.lit(65_541)).when(F.col("id") % 7 == 3, F.lit(1_048_592))
    rows = spark.range(first, first + 300).select(F.col("id").alias("event_id"), users.otherwise(F.col("id")).cast("long").alias("user_id"))
    folder = tempfile.mkdtemp()
    rows.coalesce(1).write.parquet(f"{folder}/events.parquet")
    want = catalog_queries.oracle_sql()["subnets_both_families"].replace("FROM events", f"FROM '{folder}/events.parquet/*.parquet'")
    got = catalog_queries.queries()["subnets_both_families"](spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == sorted(duckdb.sql(want).fetchall(), key=str)
