import os

import pytest
from against_sql import DIR, connect, same_rows

from plansieve.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    same_rows(spark, con, queries.QUERIES[name], queries.ORACLE_SQL[name])
