import pytest

from quillspark.plans import catalog
from tests.oracle import ours, twin


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    got, columns = ours(catalog.queries()[name](spark, sf))
    want, named = twin(catalog.oracle_sql()[name], sf)
    assert columns == named
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
