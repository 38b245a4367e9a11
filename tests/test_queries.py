import pathlib

import pytest

import scatterlake.plans as plans
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_oracle(spark, con, name):
    compare(plans.queries()[name](spark, SF), con, plans.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql()) - {"lcurve", "recon_sh", "cg_step"}))
def test_query_without_oracle_has_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
