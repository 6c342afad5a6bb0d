"""Every query of the library against its SQL on the smallest tables; those without SQL must run and give rows."""

import pytest
from duck import assert_same

from lodestone import registry

FOLDER = "/root/testdata/sf0.001"
#: On so few rows these have nothing to tell.
MAY_BE_EMPTY = {"theta_contains", "snippet_overlap", "anti_done", "contradictions", "latest_complete_group", "assert_equal_across", "score_band", "quota_floor", "differing"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    n = assert_same(df, registry.ORACLES[name], FOLDER) if name in registry.ORACLES else df.count()
    assert n or name in MAY_BE_EMPTY
