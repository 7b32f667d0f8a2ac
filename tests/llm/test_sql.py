"""Every query of the subpackage that has SQL against that SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from test_queries import connected, same_as_sql  # noqa: E402

from arqueo.llm.sql import SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    same_as_sql(spark, sf, connected(sf), name)
