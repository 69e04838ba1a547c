"""Every engine query against its SQL on the smallest tables."""

import pytest
from oracle import connection, same

from reedbank.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


#: Queries whose result is empty on the smallest tables.
LARGER = {"kmer_locate", "kmer_rows", "otu_support_having"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    sf, own = (SF, con) if name not in LARGER else (SF.replace("0.001", "0.01"), connection(SF.replace("0.001", "0.01")))
    assert same(QUERIES[name](spark, sf), own, ORACLE_SQL[name]) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
