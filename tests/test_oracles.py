"""Every registered query against its SQL twin."""

import re

import pytest

import __spark_entry__ as registered
from catalog.checking import compare, duck

SF = "/root/testdata/sf0.001"
# These are checked at the next size as well; the small tables leave them without rows.
NEEDS_MORE = "/root/testdata/sf0.01"

# The numbered operators and the pipeline have their tests beside them.
QUERIES = {
    name: query
    for name, query in registered.queries().items()
    if name != "pipeline" and not re.match(r"op\d+_", name)
}
SQL = {name: sql for name, sql in registered.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def connections():
    return {sf: duck(sf) for sf in (SF, NEEDS_MORE)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, connections, name):
    for sf in (SF, NEEDS_MORE):
        _, rows, message = compare(spark, connections[sf], QUERIES[name], SQL.get(name), sf)
        if message != "NO ROWS":
            break
    assert message in ("", "rows only"), message
    assert rows


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) == set(QUERIES)
