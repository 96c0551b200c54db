"""Every registered query runs on the smallest tables and agrees with its SQL."""

import pytest
from compare import compare

from postflow.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
# The smallest tables hold nothing that these two could report.
MAY_BE_EMPTY = {"band_gaps", "new_companies"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, SF).count() > 0
        return
    difference = compare(spark, SF, QUERIES[name], ORACLES[name])
    assert difference is None or (difference == "no rows" and name in MAY_BE_EMPTY)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
