"""The grid of a table is worked out once, and pages are read by all cores however few bytes they are made from."""

from helpers import SF

from tallyframe.catalog import documents_set
from tallyframe.operators import documents


def test_no_filter_works_out_the_grid(spark):
    pages = spark.createDataFrame([(1, "<table></table>")], "doc_id long, html string")
    plan = documents.table_cells(pages)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line.split("(")[0]]
    assert filters and not any("regexp_extract_all" in line or "RLIKE" in line for line in filters)


def test_pages_are_spread(spark):
    assert documents_set._pages(spark, SF).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
