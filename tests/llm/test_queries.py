"""The text queries that SQL can express give what DuckDB gives."""

import os

import pytest

from tests.test_queries import SF, duck, same  # noqa: F401
from wayfold.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):  # noqa: F811
    same(spark, duck, name, queries.queries()[name](spark, SF), queries.oracle_sql()[name])
