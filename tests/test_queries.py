import pytest
from oracle import assert_same

from ampliweave import queries

SF = "/root/testdata/sf0.001"
SQL, ALL = queries.oracle_sql(), queries.queries()


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, name):
    assert_same(ALL[name](spark, SF), SQL[name], SF)


@pytest.mark.parametrize("name", [n for n in ALL if n not in SQL])
def test_runs(spark, name):
    assert ALL[name](spark, SF).count() > 0
