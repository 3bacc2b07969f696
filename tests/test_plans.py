"""Chapters are dealt out once, in parts whose number follows the input; what is grouped by chapter or by more stays there."""

import pytest

from spanloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.callables()


@pytest.mark.parametrize("name", ["agg10_chapter_alignment_scores", "agg14_fleiss_kappa", "jn7_chapters_with_two_raters", "jn9_choices_of_one_rater", "agg2_row_stats", "sim1_sentence_items"])
def test_one_exchange_by_number(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange " in x]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0]
    assert "ObjectHashAggregate" not in plan and "Join" not in plan
