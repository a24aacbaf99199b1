"""Every registered query against its SQL counterpart on the smallest tables."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

import oracle  # noqa: E402

from gleanery.plans import catalog  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF_DIR)
    if name in SQL:
        assert oracle.compare(df, db, SQL[name]) is None
    else:
        assert df.count() >= 0
