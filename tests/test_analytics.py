import pytest
from pyspark.sql import functions as F

from tallyframe.catalog.common import no_issues
from tallyframe.operators import analytics, summary
from tallyframe.sources import specs

BALANCES = ("total_equity", "total_assets", "backlog", "total_liabilities")


def run(make_facts, fw, rows, only, issues=None, **kw):
    facts = make_facts(rows, instants=BALANCES, framework=next(iter(fw)), **kw)
    events = analytics.run_analytics(facts, no_issues(facts.sparkSession) if issues is None else issues, fw, only)
    return {(r.analytic_id, r.fiscal_year): (None if r.value is None else round(r.value, 6), r.reason) for r in events.collect()}


@pytest.mark.parametrize("values,expected", [
    ((100, 110, 99), [(None, "start_of_history:operating_income"), (0.1, None), (-0.1, None)]),
    ((-50, 20), [(None, "start_of_history:operating_income"), (None, "growth_base_not_positive:operating_income")]),
    ((100, -50), [(None, "start_of_history:operating_income"), (None, "growth_sign_change:operating_income")]),
    ((100, 0), [(None, "start_of_history:operating_income"), (None, "growth_sign_change:operating_income")]),
])
def test_growth(make_facts, generic, values, expected):
    got = run(make_facts, generic, [("operating_income", f"FY{2020 + i}", v) for i, v in enumerate(values)], ["operating_income_growth"])
    assert [got[("operating_income_growth", 2020 + i)] for i in range(len(values))] == expected


def test_balance_bases(make_facts, generic, frameworks):
    got = run(make_facts, generic, [("net_income", "FY2024", 120), ("total_equity", "FY2023", 1000), ("total_equity", "FY2024", 1400)], ["return_on_average_equity"])
    assert got[("return_on_average_equity", 2024)] == (0.1, None)
    assert got[("return_on_average_equity", 2023)][1] == "input_missing:net_income"
    got = run(make_facts, {"industrials": frameworks["industrials"]}, [("revenue", "FY2024", 900), ("backlog", "FY2023", 1200), ("backlog", "FY2024", 5000)], ["backlog_conversion"])
    assert got[("backlog_conversion", 2024)] == (0.75, None)


def test_expression_and_elasticity(make_facts, generic):
    got = run(make_facts, generic, [("operating_income", "FY2024", 200), ("income_tax_expense", "FY2024", 45), ("pre_tax_income", "FY2024", 180)], ["nopat"])
    assert got[("effective_tax_rate", 2024)] == (0.25, None) and got[("nopat", 2024)] == (150.0, None)
    rows = [("revenue", "FY2023", 100), ("revenue", "FY2024", 110), ("operating_income", "FY2023", 20), ("operating_income", "FY2024", 25)]
    assert run(make_facts, generic, rows, ["degree_of_operating_leverage"])[("degree_of_operating_leverage", 2024)] == (2.5, None)


def test_gate_blocks_errors_and_flags_warnings(spark, make_facts, generic):
    issues = spark.createDataFrame([("co", "sign", "error", "revenue", "FY2024", ["fact_0000000000000000"], {}), ("co", "scale_break", "warning", None, None, ["fact_0000000000000001"], {}),
                                    ("co", "z", "error", "revenue", "FY2022", [], {})], no_issues(spark).schema)
    rows = [("revenue", "FY2024", 10), ("net_income", "FY2024", 2), ("revenue", "FY2023", 10), ("net_income", "FY2023", 2), ("revenue", "FY2022", 1), ("net_income", "FY2022", 1)]
    got = run(make_facts, generic, rows, ["net_margin"], issues)
    assert got == {("net_margin", 2024): (None, "input_failed_quality:sign"), ("net_margin", 2023): (0.2, None), ("net_margin", 2022): (None, "input_failed_quality:z")}
    facts = make_facts(rows)
    flagged = analytics.run_analytics(facts, issues.filter("severity = 'warning'"), generic, ["net_margin"]).filter("fiscal_year = 2024").first()
    assert flagged.quality_flags == ["scale_break"] and flagged.input_fact_ids == ["fact_0000000000000001", "fact_0000000000000000"]


def test_growth_of_an_analytic(make_facts, generic):
    from dataclasses import replace

    base = generic["generic"]
    growth = specs.Analytic("net_debt_growth", "Net debt growth", "growth", "growth", "ratio", metric="net_debt")
    fw = {"generic": replace(base, analytics=base.analytics | {"net_debt_growth": growth})}
    facts = make_facts([(m, f"FY{y}", v) for y, d in ((2022, 10), (2023, 12)) for m, v in (("total_debt", d), ("cash_and_equivalents", 5))], instants=("total_debt", "cash_and_equivalents"))
    got = {(r.analytic_id, r.fiscal_year): r.value for r in analytics.run_analytics(facts, no_issues(facts.sparkSession), fw, ["net_debt_growth"]).collect()}
    assert round(got[("net_debt_growth", 2023)], 6) == 0.4 and got[("net_debt_growth", 2022)] is None


def values_frame(spark, values, analytic="net_debt", kind="expression", unit="currency"):
    rows = [("co", "generic", analytic, kind, unit, y, float(v), [], False) for y, v in values]
    return spark.createDataFrame(rows, "company_id string, framework string, analytic_id string, kind string, unit_kind string, fiscal_year int, value double, quality_flags array<string>, uses_derived boolean")


def test_summary(spark, generic):
    s = summary.series_summary(values_frame(spark, [(2020 + i, 100 * 1.1**i) for i in range(6)]), generic).first()
    assert round(s.cagr_full, 6) == round(s.cagr_3y, 6) == round(s.cagr_5y, 6) == 0.1 and s.observations == 6 and s.trend_per_year > 10
    assert round(s.avg_3y, 4) == round((133.1 + 146.41 + 161.051) / 3, 4)
    broken = summary.series_summary(values_frame(spark, [(2018, 1), (2020, 2), (2021, 3)]), generic).first()
    assert broken.avg_3y is None and broken.avg_5y is None and broken.trend_per_year is None and broken.down_years is None


def test_drawdown(spark):
    df = spark.createDataFrame([("co", "a", 2019 + i, float(v)) for i, v in enumerate((100, 80, 120, 60, 90))] + [("co", "b", 2019 + i, float(v)) for i, v in enumerate((1, 2, 3))]
                               + [("co", "c", 2019, -1.0), ("co", "c", 2020, -2.0)], "company_id string, series_id string, fiscal_year int, value double")
    assert [(r.series_id, r.decline, r.peak_year, r.trough_year) for r in summary.max_drawdown(df).collect()] == [("a", -0.5, 2021, 2022)]


def test_year_words(spark):
    df = spark.createDataFrame([([2018, 2016, 2017, 2021],), ([2020],), ([2015, 2017, 2019],)], "years array<int>")
    assert [r.t for r in df.select(summary.years_text(F.col("years")).alias("t")).collect()] == ["FY2016–FY2018 and FY2021", "FY2020", "FY2015, FY2017 and FY2019"]
