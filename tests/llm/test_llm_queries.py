import pytest

from tessera.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_rows_are_those_of_the_sql(matches_sql, name):
    assert matches_sql(Q.QUERIES[name], Q.ORACLE[name])
