import os

import pytest

from kbspark.operators import chunking, context, evaluation, inference, ledger, quality, reconcile, reference_queries, retrieval, routing, sheets, versions
from kbspark.plans import shapes
from kbspark.sources import sinks
from kbspark.streaming import ingest
from tests.oracle import SMALL, rows_of, rows_of_sql

MODULES = [shapes, reference_queries, ledger, versions, reconcile, retrieval, inference, sheets, chunking, evaluation, quality, context, routing, sinks, ingest]
QUERIES = {n: (q, m.SQL.get(n)) for m in MODULES for n, q in m.QUERIES.items()}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    query, sql = QUERIES[name]
    found = rows_of(query(spark, SMALL))
    if sql:
        assert found == rows_of_sql(sql)


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
