import pytest

from pathloom.llm.queries import QUERIES
from pathloom.llm.sql import SQL
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same_rows(spark, small, name):
    compare(QUERIES[name], SQL[name], spark, small)
