"""Every query of the core against its SQL, or at least for rows, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from arbora.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(name, compare):
    compare(catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_gives_rows(name, spark, sf):
    df = catalogue.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_strict_kinds_of_a_small_file_take_all_tasks(spark, sf):
    assert catalogue.QUERIES["node_kinds_strict"](spark, sf).select(F.spark_partition_id()).distinct().count() == 4


def test_loose_kinds_of_a_small_file_take_all_tasks(spark, sf):
    assert catalogue.QUERIES["node_kinds_loose"](spark, sf).select(F.spark_partition_id()).distinct().count() == 4
