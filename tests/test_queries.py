"""Every registered query equals its SQL on the small data set."""

import check_queries
import pytest

import __spark_entry__ as entry
from sparkveil import catalog

catalog.load()
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return check_queries.connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    status, rows, _, note = check_queries.compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert status in ("ok", "rows-only"), note
    if status == "rows-only":
        assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"r13_learned", "s16_fingerprints"}
