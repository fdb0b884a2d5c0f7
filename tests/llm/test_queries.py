"""The registered queries against their SQL, and all of them run on the smallest tables."""

import pytest

from sheafline.llm import queries
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, duck, name):
    assert differences(spark, duck, queries.queries()[name], queries.oracle_sql()[name], SF_DIR) == ""


def test_every_operator_is_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] == [f.__name__ for f in queries.queries().values()]
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
