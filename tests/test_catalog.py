"""Every catalogue query against its SQL on the smallest tables."""

import pytest

from sheafline.plans import catalog
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.ALL))
def test_query(spark, duck, name):
    query, sql = catalog.ALL[name]
    if sql is None:
        assert query(spark, SF_DIR).count() > 0
    else:
        assert differences(spark, duck, query, sql, SF_DIR) == ""


def test_header_vote_sees_all_customers(spark, tmp_path):
    rows = [(k, f"name {k}" if k < 50 else str(k), k % 25, 1.0 * k) for k in range(1, 1000)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["col"]: r["body_kind"] for r in catalog.ALL["header_votes"][0](spark, str(tmp_path)).collect()}
    assert got == {1: "number", 2: "number", 3: "number"}
