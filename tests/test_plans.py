"""Every registered query of the event operators against its SQL."""

import pytest

from __spark_entry__ import PLANS

from .oracle import connect, differences

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = {}, {}
for plans in PLANS:
    QUERIES |= plans.QUERIES
    ORACLES |= plans.ORACLES


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    out = QUERIES[name](spark, DATA)
    if name in ORACLES:
        assert differences(out, db, ORACLES[name]) == []
    else:
        assert out.count() > 0
