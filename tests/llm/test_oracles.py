import pytest

pytest.importorskip("chronoweave.llm")
from chronoweave.llm import registry  # noqa: E402

from oracle import same  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)
