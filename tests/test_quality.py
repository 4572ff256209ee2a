import pytest
from pyspark.sql import functions as F

from tallyframe.operators import checks, derive
from helpers import day


def derived(facts, fw):
    return {r.fiscal_period: (float(r.value), len(r.inputs)) for r in derive.interim_facts(derive.interim_events(facts, fw)).collect()}


def test_interim_from_year_to_date(make_facts, generic):
    facts = make_facts([("revenue", "Q1-2024", 100), ("revenue", "H1-2024", 210), ("revenue", "9M-2024", 330), ("revenue", "FY2024", 460)])
    assert derived(facts, generic) == {"Q2": (110, 2), "Q3": (120, 2), "Q4": (130, 2), "H2": (250, 2)}


def test_interim_without_year_to_date(make_facts, generic):
    facts = make_facts([("revenue", "Q1-2024", 100), ("revenue", "Q2-2024", 110), ("revenue", "Q3-2024", 120), ("revenue", "FY2024", 460)])
    assert derived(facts, generic) == {"Q4": (130, 4)}


def test_interim_refusals(make_facts, generic):
    facts = make_facts([("revenue", "9M-2024", 330, {"period_start": day("2024-02-01")}), ("revenue", "FY2024", 460), ("diluted_shares", "FY2024", 10, {"unit": "shares", "currency": None})])
    events = derive.interim_events(facts, generic)
    assert [r.outcome for r in events.collect()] == ["interim_periods_not_contiguous"]
    counts = {r.event: r.n for r in derive.derivation_counts(facts, events, derive.formula_events(facts, generic), generic).collect()}
    assert counts["interim_not_derivable_non_additive:diluted_shares"] == 1 and counts["interim_periods_not_contiguous:revenue"] == 1


def test_formula_metrics_and_reported_wins(make_facts, generic):
    facts = make_facts([("revenue", "FY2024", 1000), ("cost_of_revenue", "FY2024", 600), ("operating_cash_flow", "FY2024", 300), ("capital_expenditure", "FY2024", 120),
                        ("revenue", "FY2023", 1000), ("cost_of_revenue", "FY2023", 600), ("gross_profit", "FY2023", 420)])
    events = derive.formula_events(facts, generic)
    assert {(r.metric_id, r.fiscal_year): float(r.value) for r in derive.formula_facts(events).collect()} == {("gross_profit", 2024): 400, ("free_cash_flow", 2024): 180}
    assert [(r.metric_id, r.period, r.severity) for r in derive.formula_issues(events).collect()] == [("gross_profit", "FY2023", "warning")]


@pytest.mark.parametrize("gross,expected", [("400000000", "passed"), ("420000000", "failed")])
def test_consistency(make_facts, generic, gross, expected):
    facts = make_facts([("revenue", "FY2024", 1000000000), ("cost_of_revenue", "FY2024", 600000000), ("gross_profit", "FY2024", gross)])
    assert [r.outcome for r in derive.formula_events(facts, generic).filter("metric_id = 'gross_profit'").collect()] == [expected]


def test_mixed_currency_and_division_by_zero(make_facts, generic):
    facts = make_facts([("revenue", "FY2024", 10), ("cost_of_revenue", "FY2024", 6, {"unit": "EUR", "currency": "EUR"}), ("net_income", "FY2024", 5), ("diluted_shares", "FY2024", 0, {"unit": "shares", "currency": None})])
    got = {r.metric_id: r.outcome for r in derive.formula_events(facts, generic).collect()}
    assert got["gross_profit"] == "mixed_currency" and got["diluted_eps"] == "division_by_zero"


def test_identity_rounding_and_optional_terms(make_facts, generic):
    balances = ("total_assets", "total_liabilities", "total_equity")
    facts = make_facts([("total_assets", "FY2024", 3000001000), ("total_liabilities", "FY2024", 2000000000), ("total_equity", "FY2024", 1000000000),
                        ("operating_cash_flow", "FY2024", 10), ("investing_cash_flow", "FY2024", -4), ("financing_cash_flow", "FY2024", -1), ("net_change_in_cash", "FY2024", 5)], instants=balances)
    got = {r.check_id: (r.outcome, r.omitted) for r in checks.identity_events(facts, generic).collect()}
    assert got["balance_sheet_identity"] == ("passed", "") and got["cash_flow_statement_sum"] == ("passed", "fx_effect_on_cash") and got["cash_roll_forward"][0] == "not_evaluable"


def test_opening_balance_up_to_eight_days_before(make_facts, generic):
    cash = "cash_and_restricted_cash"
    rows = [(cash, "FY2024", 400, {"period_end": day("2024-12-28")}), (cash, "FY2025", 405), ("net_change_in_cash", "FY2025", 5)]
    events = checks.identity_events(make_facts(rows, instants=(cash,)), generic).filter("check_id = 'cash_roll_forward'").collect()
    assert [r.outcome for r in events] == ["passed"]
    late = [(cash, "FY2024", 400, {"period_end": day("2024-12-20")}), *rows[1:]]
    assert [r.outcome for r in checks.identity_events(make_facts(late, instants=(cash,)), generic).filter("check_id = 'cash_roll_forward'").collect()] == ["not_evaluable"]


def test_series_checks(make_facts, generic):
    years = dict(zip(range(2019, 2026), (100, 105, 110, 116, 121, 127, 400), strict=True))
    changes = checks.annual_changes(make_facts([("revenue", f"FY{y}", v) for y, v in years.items()]))
    flagged = [r.fiscal_year for r in checks.unusual_changes(changes).filter("outcome = 'failed'").collect()]
    assert flagged == [2025]
    few = checks.unusual_changes(checks.annual_changes(make_facts([("revenue", f"FY{y}", 10) for y in (2020, 2021, 2022)]))).collect()
    assert [r.outcome for r in few] == ["not_evaluable"]
    scale = checks.annual_changes(make_facts([("revenue", "FY2020", 3.0e6), ("revenue", "FY2021", 3.1e9), ("cost_of_revenue", "FY2020", 3e6), ("cost_of_revenue", "FY2021", 6e6)])).filter("consecutive")
    assert {r.metric_id: r.scale_outcome for r in scale.collect()} == {"revenue": "failed", "cost_of_revenue": "passed"}
    gaps = checks.missing_years(make_facts([("revenue", f"FY{y}", 1) for y in (2015, 2016, 2019)])).first()
    assert gaps.missing == [2017, 2018] and gaps.outcome == "failed"


def test_run_quality_end_to_end(make_facts, generic):
    rows = [("revenue", "Q1-2024", 14), ("revenue", "H1-2024", 29), ("revenue", "9M-2024", 44), ("revenue", "FY2024", 60), ("revenue", "FY2023", -5), ("cost_of_revenue", "FY2024", 20)]
    quality = checks.run_quality(make_facts(rows), generic, historical_years=5)
    assert {r.fiscal_period for r in quality.derived.filter("metric_id = 'revenue'").collect()} == {"Q2", "Q3", "Q4", "H2"}
    issues = {(r.check_id, r.severity) for r in quality.issues.collect()}
    assert issues == {("sign", "error"), ("history_length", "info")}
    rolled = {r.check_id: (r.passed, r.failed, r.not_evaluable) for r in checks.check_rollup(quality.outcomes).collect()}
    assert rolled["sign"] == (9, 1, 0) and rolled["scale_break"] == (0, 0, 1)
    assert {(r.metric_id, r.fiscal_year, r.cell) for r in quality.coverage.collect()} >= {("revenue", 2024, "R"), ("gross_profit", 2024, "D")}


def test_no_full_row_count_is_lost(make_facts, generic):
    """Every anchor with any input yields exactly one event per formula."""
    facts = make_facts([("revenue", f"FY{y}", y) for y in range(2000, 2020)])
    assert derive.formula_events(facts, generic).filter("metric_id = 'gross_profit'").agg(F.count("*")).first()[0] == 20


def test_coverage_matrix_has_every_year(spark):
    from tallyframe.catalog import facts_set

    cells = spark.createDataFrame([(1, "revenue", 1989, "R"), (1, "revenue", 2024, "D"), (2, "gross_profit", 1996, "R")], "company_id int, metric_id string, fiscal_year int, cell string")
    got = facts_set.coverage_by_year(cells).orderBy("company_id")
    assert got.columns == ["company_id", "metric_id", "fy1989", "fy1996", "fy2024"]
    assert [tuple(r) for r in got.collect()] == [(1, "revenue", "R", None, "D"), (2, "gross_profit", None, "R", None)]
