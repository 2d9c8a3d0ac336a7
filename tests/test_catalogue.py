import pytest

from lodestone import catalogue
from tests.oracle import given, wanted

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_rows_equal_the_oracle(spark, name):
    names, rows = given(catalogue.QUERIES[name](spark, SF))
    expected_names, expected = wanted(catalogue.ORACLES[name], SF)
    assert names == expected_names
    assert rows == expected
    assert rows


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_runs_without_an_oracle(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
