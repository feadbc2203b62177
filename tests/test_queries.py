import os

import pytest

from tests.oracle import SF_DIR, same
from tracewell.plans import ORACLES, QUERIES

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables here")


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_each_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
