"""Queries over documents build them once."""

from pathlib import Path

from conftest import SF

from commerce_lake.plans import QUERIES


def built(spark, name):
    """Documents stored by the query, and whether its last step reads the lines again."""
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    count = lambda: len(list(root.glob("docs-*")))
    before = count()
    df = QUERIES[name](spark, SF)
    df.collect()
    return count() - before, "l_partkey" in df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_built_once(spark):
    assert built(spark, "reconcile_structures") == (1, False)  # three builds before
    assert built(spark, "sku_hit") == (0, True)
    for name in ("fuzzy_candidates", "plan_queries", "extract_intent"):  # the vocabulary or the phrases are stored
        assert built(spark, name) == (0, False)
