"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from arbora.plans.queries import QUERIES, SQL, queries_c
from tests.compare import connect, rows_of_spark, rows_of_sql

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    names, found = rows_of_spark(QUERIES[name](spark, DATA))
    wanted_names, wanted = rows_of_sql(con, SQL[name])
    assert names == wanted_names
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    assert rows


def test_mosaic_takes_every_tile(spark, monkeypatch):
    """400 tiles at sf0.1; the SQL, which takes the first 100, has the same rows as the cut shows none of the others."""
    folder, seen = "/root/testdata/sf0.1", []
    mosaic = queries_c.chips.mosaic
    monkeypatch.setattr(queries_c.chips, "mosaic", lambda pixels, order: seen.append(pixels) or mosaic(pixels, order))
    found = rows_of_spark(QUERIES["c17_mosaic_cut"](spark, folder))
    assert seen[0].select("tile").distinct().count() == 400
    assert found == rows_of_sql(connect(folder), SQL["c17_mosaic_cut"])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
