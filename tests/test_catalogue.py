"""Each query against its SQL, run by another engine."""

from __future__ import annotations

import pytest

from sluicebox.plans import catalogue


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: None if isinstance(x, float) and x != x else x
    return sorted(repr(tuple(clean(r[i]) for i in order)) for r in rows)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_as_sql(name, spark, data, duck):
    got = catalogue.QUERIES[name](spark, data)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_partitions_do_not_matter(spark, data):
    """Results stay when tables are dealt out in other ways."""
    names = ["stratified_take", "build_splits", "stable_order", "dedup_prefix200", "latest_wins", "order_recovery_first", "length_bucket"]
    before = {n: rows_of((d := catalogue.QUERIES[n](spark, data)).columns, [tuple(r) for r in d.collect()]) for n in names}
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in names:
            d = catalogue.QUERIES[n](spark, data)
            assert rows_of(d.columns, [tuple(r) for r in d.collect()]) == before[n], n
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
