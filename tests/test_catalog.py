"""Every query of the engine against its SQL."""

import os

import pytest
from helpers import check_query
from pyspark.sql import functions as F

from kvstrata import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    check_query(spark, sf_dir, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_crc_of_chunks_is_ieee(spark, sf_dir):
    import zlib

    from pyspark.sql import functions as F

    from kvstrata.operators import chunks

    rows = chunks.split(catalog.blobs(spark, sf_dir), 1024).select("data", "crc32").limit(50).collect()
    assert all(zlib.crc32(r.data) == r.crc32 for r in rows)
    assert spark.range(1).select(F.crc32(F.lit(b"123456789"))).first()[0] == 3421780262


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5


def _with_events(sf_dir, tmp_path, events):
    """A folder of the driver tables with other events."""
    for name in os.listdir(sf_dir):
        if name != "events.parquet":
            os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    events.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["bloom_fp", "kv_bloom_semi"])
def test_bloom_filters_follow_the_keys(spark, sf_dir, tmp_path, name):
    user = F.when(F.col("id") > 0, F.col("id")).alias("user_id")  # one is null
    events = spark.range(60_000).select(F.col("id").alias("event_id"), user, F.lit("view").alias("event_type"), F.lit('{"k": 1}').alias("props"))
    check_query(spark, _with_events(sf_dir, tmp_path, events), catalog.queries()[name], catalog.oracle_sql()[name])
