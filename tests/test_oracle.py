import pytest

from lurewatch.plans import registry_jobs  # noqa: F401
from lurewatch.plans.registry import ORACLE, QUERIES
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    msg = compare(spark, con, SF, name, QUERIES[name], ORACLE[name])
    assert msg is None


@pytest.mark.parametrize("name", ["train_report", "feature_importance_topk"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).columns == ["stage", "verdict", "n"]
    assert set(E.oracle_sql()) <= set(E.queries())
