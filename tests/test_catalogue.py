import pytest
from compare import differs

from quillspark import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, name):
    assert differs(spark, name, catalogue.queries()[name], catalogue.oracle_sql()[name], SF) == ""


def test_flagship_pages_and_text(spark):
    got = catalogue.flagship(spark, SF)
    assert got.count() == 200
    assert got.where("error IS NOT NULL OR total_pages < 1").count() == 0
