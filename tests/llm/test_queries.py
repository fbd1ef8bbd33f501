import pytest

from sylvaframe.llm import queries as corpus

from ..compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_against_sql(spark, name):
    assert compare(spark, name, corpus.queries()[name], corpus.oracle_sql()[name], SF) == ""
