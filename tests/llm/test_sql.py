"""The queries that have SQL, against it."""

import pytest
from conftest import SF_DIR
from oracle import differences

from cartulary.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), ORACLE[name], SF_DIR) == ""
