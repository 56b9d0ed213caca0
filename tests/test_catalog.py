"""Every query against its SQL; every query without SQL returns rows."""

import pytest

from tessera.plans import catalog
from tests.helpers import same

#: Empty at the smallest scale by the nature of the data.
MAY_BE_EMPTY = {"alias_overlap_dedup", "forge_augment"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    found = same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.ORACLES[name])
    assert found or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).collect() or name in MAY_BE_EMPTY
