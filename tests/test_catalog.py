"""Every registered query of the library against its SQL, or for its rows where it has none."""

import pytest

from tests.oracle import same
from tracewright.plans import registry


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        same(df, registry.ORACLES[name], sf)
    else:
        assert df.count() > 0
