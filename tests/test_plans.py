import os
import re

import pytest

from spanloom.plans import catalogue

D = "/root/testdata/sf0.001"
LAZY = ["p2_found", "p5_found", "span_overlap", "span_islands", "span_edge_trim", "span_nearest", "page_context", "label_confusion", "triage_summary", "passage_containment"]


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
@pytest.mark.parametrize("name", LAZY)
def test_plans_have_no_product_and_read_few_columns(spark, name):
    plan = catalogue.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    read = re.findall(r"ReadSchema: struct<([^\n]*)", plan)
    assert read and all(len(re.sub(r"<.*?>", "", r).split(",")) <= 10 for r in read)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
def test_page_sources_are_pruned(spark):
    plan = catalogue.queries()["p2_found"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "verdicts" not in plan and "expert_text" not in plan
