"""Registry of queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from reedbank.session import plain_unions

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark, sf_dir):
            plain_unions(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
