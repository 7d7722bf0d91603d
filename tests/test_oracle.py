"""Every registered query with an oracle gives the oracle's rows."""

import duckdb
import pytest

from __spark_entry__ import entry, queries
from check import TABLES, canonical
from lakework.plans import ORACLE, QUERIES

ORACLES = ORACLE


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, sf_dir, name):
    ours = queries()[name](spark, sf_dir).toArrow()
    theirs = con.sql(ORACLES[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert canonical(ours) == canonical(theirs)


def test_entry_gives_rows(spark):
    assert entry(spark).limit(1).count() == 1


def test_every_query_is_named_by_what_it_does():
    for name in QUERIES:
        assert name.islower() and "pipeline" not in name and not name.startswith("op")
