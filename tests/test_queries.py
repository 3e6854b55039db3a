"""Every query with SQL against DuckDB on the smallest tables; the others must give rows."""

import os

import oracle
import pytest

from tidewater import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    if name in catalogue.ORACLE_SQL:
        assert oracle.differences(spark, SF, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], duck) is None
    else:
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_kmeans_split_has_all_starts(spark, monkeypatch):
    """The query leaves the starts to the operator's default of ten."""
    from tidewater.operators import strategy

    given, real = {}, strategy.split_topic
    monkeypatch.setattr(strategy, "split_topic", lambda *a, **k: given.update(k, n=len(a)) or a[0])
    assert catalogue.QUERIES["kmeans_split"](spark, SF).count() > 0
    assert given == {"n": 3} and len(real.__defaults__[-1]) == 10


def test_entry_point_imports_and_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.QUERIES) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    got = e.entry(spark)
    assert got.count() > 0 and "equilibrium_type" in got.columns
