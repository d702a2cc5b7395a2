"""The registered text queries against their SQL, where they have one."""

import pytest

from tests.oracle import assert_same, connect
from thicket import llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    assert_same(spark, connect(sf), sf, llm.queries()[name], llm.oracle_sql()[name])


def test_each_operator_has_a_query():
    assert {n.split("_")[0] for n in llm.queries()} == {f"op{k}" for k in range(1, 11)}
