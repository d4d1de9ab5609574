"""What the driver imports: the library's queries, and the corpus part only where it is there."""

from __future__ import annotations

import __spark_entry__


def test_parts_that_are_not_there_are_left_out():
    assert __spark_entry__._there("tidemark.plans") and not __spark_entry__._there("tidemark.nothing") and not __spark_entry__._there("no_such_module")


def test_each_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_a_stable_schema(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "queue_name" and df.count() == 5
