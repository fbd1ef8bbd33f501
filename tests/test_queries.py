import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from sylvaframe import queries as library

from .compare import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _outcome(spark, name):
    """'' if the query gives the rows of its SQL, or some rows where it has none; else what is wrong."""
    try:
        if name in library.ORACLES:
            return compare(spark, name, library.QUERIES[name], library.ORACLES[name], SF)
        return "" if library.QUERIES[name](spark, SF).count() > 0 else f"{name}: no rows"
    except Exception as e:  # shown by the query's own test
        return f"{name}: {type(e).__name__}: {e}"


@pytest.fixture(scope="module")
def outcomes(spark, request):
    """The outcome of each query that was asked for; some run beside each other, as most of their time is start-up."""
    names = [i.callspec.params["name"] for i in request.session.items if i.module is request.module]
    with ThreadPoolExecutor(5) as pool:
        return dict(zip(names, pool.map(lambda name: _outcome(spark, name), names)))


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query_against_sql(outcomes, name):
    assert outcomes[name] == ""


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_query_runs(outcomes, name):
    assert outcomes[name] == ""
