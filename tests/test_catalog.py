import pytest

from cadenza.plans import catalog
from tests.oracle import compare, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    compare(catalog.QUERIES[name](spark, SMALL), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_an_oracle_can_fail(spark, con):
    wrong = catalog.ORACLES["container_duration"].replace("/ 1e6", "/ 1e5")
    with pytest.raises(AssertionError):
        compare(catalog.QUERIES["container_duration"](spark, SMALL), con, wrong)


def test_partitioning_does_not_matter(spark, con):
    name, before = "trim_keyframe_iso", spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            compare(catalog.QUERIES[name](spark, SMALL), con, catalog.ORACLES[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
