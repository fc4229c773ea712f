"""Every registered query of the plans against its SQL."""

import pytest
from conftest import SF_DIR
from oracle import differences

from cartulary.plans.queries import ORACLE, QUERIES, flagship


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), ORACLE[name], SF_DIR) == ""


def test_fuzzy_match_takes_every_tier(spark):
    rows = QUERIES["fuzzy_match"](spark, SF_DIR).collect()
    assert {r.join_method for r in rows} >= {"fuzzy_score", "manual_review"}


def test_flagship(spark):
    rows = flagship(spark, SF_DIR).collect()
    assert 0 < len(rows) <= 15
    scores = [r.score_priorizacao_territorial_sp for r in rows]
    assert scores == sorted(scores, reverse=True)
