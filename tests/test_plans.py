import pytest

from paperloom.plans import catalog


@pytest.mark.parametrize("name", ["uncovered_sentences", "eval_modes", "visible_edges", "neighbors"])
def test_texts_are_not_read_again_by_the_plan(spark, name):
    """What is used several times is a table by then: sentences, rankings, mentions."""
    found = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert "documents.parquet" not in found._jdf.queryExecution().executedPlan().toString()
