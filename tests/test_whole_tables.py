"""Queries of the catalogue read whole tables."""

import pytest

from gapwise import catalog


@pytest.mark.parametrize("name", ["nearest_node", "network_access", "gap_classification", "ward_summary"])
def test_every_customer_is_an_origin(spark, sf, name):
    wards = sorted(r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").collect())
    assert sorted(r.ward for r in catalog.QUERIES[name](spark, sf).collect()) == wards


def test_every_supplier_is_a_source(spark, sf):
    n = spark.read.parquet(f"{sf}/supplier.parquet").count()
    assert catalog.QUERIES["shortest_paths"](spark, sf).count() == n * n


def test_dedupe_reads_the_whole_table(spark, sf):
    rows = [(r.l_suppkey, r.l_quantity, r.l_returnflag) for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect()]
    assert tuple(catalog.QUERIES["dedupe_rows"](spark, sf).first()) == (len(rows), len(set(rows)), len(rows) - len(set(rows)))
