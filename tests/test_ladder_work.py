"""Assumptions are picked inside a row: demands and declarations meet as one row a company and key, and are not sorted together."""

from tallyframe.plans import forecast

DECLARED = "company_id string, key string, type string, period string, scenario string, value double, source_document_id string"


def test_pairs_are_not_aggregated(spark):
    demands = spark.createDataFrame([("co", "base", "k", 2030), ("co", "base", "k", 2030), ("co", "bull", "k", 2031), ("co", "base", "other", 2030)], "company_id string, scenario string, key string, fiscal_year int")
    declared = spark.createDataFrame([("co", "k", "historical", None, None, 1.0, None), ("co", "k", "consensus", "FY2031", None, None, "d"), ("co", "k", "scenario", None, "bear", 9.0, None), ("co", "k", None, None, None, 7.0, None)], DECLARED)
    found = forecast.resolve_assumptions(demands, declared)
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda word: [i for i, line in enumerate(plan) if line.lstrip(" :+-").startswith(word)]
    assert depth("Join") and min(depth("Aggregate")) > min(depth("Join"))
    assert sorted((r.scenario, r.key, r.fiscal_year, r.value, r.type, r.pinned, r.reason) for r in found.collect()) == [
        ("base", "k", 2030, 1.0, "historical", False, None), ("base", "other", 2030, None, None, None, "assumption_missing:other"), ("bull", "k", 2031, None, "consensus", True, "assumption_unset:k")]
