"""Queries over files whose tasks stay bounded: more rows make more files or partitions, and the same results."""

import os

import pytest

from binforge.plans import file_queries, queries
from binforge.sources import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_csv_files_are_of_a_bounded_size(spark, monkeypatch):
    read, stored = [], []
    select, store = catalog.select_file, file_queries._stored
    monkeypatch.setattr(catalog, "select_file", lambda *a: read.append(a[1]) or select(*a))
    monkeypatch.setattr(file_queries, "_stored", lambda s, rows: stored.append(rows) or store(s, rows.repartition(5)))
    whole = file_queries.select_single_file(spark, SF).collect()
    assert len(read) == 1 and "Coalesce" not in stored[0]._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(file_queries, "CSV_ROWS", 300)
    assert file_queries.select_single_file(spark, SF).collect() == whole and len(read) > 2


@pytest.mark.parametrize("name", ["head_in_file_order", "compact_in_order"])
def test_sorts_are_of_a_bounded_size(spark, monkeypatch, name):
    whole = sorted(map(tuple, getattr(queries, name)(spark, SF).collect()))
    monkeypatch.setattr(queries, "SORTED_ROWS", 100)
    assert sorted(map(tuple, getattr(queries, name)(spark, SF).collect())) == whole
    assert queries._ranges(spark.range(1001)) == 11 and queries._ranges(spark.range(0)) == 1
