"""Sentences of data-check findings, from their details."""

from pyspark.sql import functions as F

from tallyframe.functions import display
from tallyframe.operators import checks, extract
from tallyframe.sources.specs import metric_spec


def test_year_ranges(spark):
    rows = [(1, [2016, 2017, 2018, 2021]), (2, [2020]), (3, [2001, 2003, 2005]), (4, [2003, 2001, 2002])]
    got = spark.createDataFrame(rows, "i int, y array<int>").select("i", display.year_ranges(F.col("y")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {1: "FY2016–FY2018 and FY2021", 2: "FY2020", 3: "FY2001, FY2003 and FY2005", 4: "FY2001–FY2003"}


def told(spark, frameworks, rows):
    df = spark.createDataFrame([("co", "generic", *r) for r in rows], "company_id string, framework string, check_id string, severity string, metric_id string, period string, details map<string,string>")
    return {r.check_id: (r.check_label, r.text) for r in display.issue_text(df, display.name_table(spark, frameworks), F.lit("USD")).collect()}


def test_sentences(spark, frameworks):
    got = told(spark, frameworks, [
        ("derivation:net_income", "warning", "net_income", "FY2031", {"reported": "1000000", "computed": "900000", "formula": "pre_tax_income - income_tax_expense"}),
        ("missing_years", "warning", "revenue", None, {"missing": "2030,2028,2029"}),
        ("restatement", "info", "total_debt", "Q3-2031", {"values": "5000000000|10-Q|2031-11-02;5010000000|10-Q/A|2032-01-15", "unit_kind": "currency"}),
        ("history_length", "info", None, None, {"metrics": "revenue, total_debt", "configured_years": "10"}),
        ("unusual_change", "info", "revenue", "FY2031", {"change": "0.5"}),
    ])
    assert got["derivation:net_income"][1] == "Reported net income ($1m) differs from pre-tax income minus income tax expense ($900,000.00) by $100,000.00. The company may define this line differently."
    assert got["missing_years"][1] == "Revenue has no annual figure for FY2028–FY2030."
    assert got["restatement"][1] == "Total debt for Q3 FY2031 was revised in a later filing: $5.00bn in the 10-Q filed 2 Nov 2031, then $5.01bn in the 10-Q/A filed 15 Jan 2032. The latest figure is used."
    assert got["history_length"][1] == "Fewer than 10 years of history for revenue, total debt."
    assert got["unusual_change"][1] == "Revenue changed by +50.0% in FY2031, well outside its usual range. Worth checking before relying on it."


def test_restated_versions_reach_the_sentence(spark, frameworks):
    rows = [("co", "revenue", "duration", "2031-12-31", "FY2031", v, value, "USD", form, filed) for v, value, form, filed in ((2, 3.25e9, "10-K/A", "2032-05-01"), (1, 3.2e9, "10-K", "2032-02-01"))]
    df = spark.createDataFrame(rows, "company_id string, metric_id string, period_type string, period_end string, period string, version int, value double, unit string, form string, filed string").withColumn("filed", F.to_date("filed"))
    none = spark.createDataFrame([], "company_id string, metric_id string, concepts array<string>")
    no_currency = spark.createDataFrame([], "company_id string, metric_id string, currency string, n long")
    issues = checks.extraction_issues(df, none, no_currency).withColumn("framework", F.lit("generic"))
    text = display.issue_text(issues, display.name_table(spark, frameworks), F.lit("USD")).first().text
    assert text == "Revenue for FY2031 was revised in a later filing: $3.20bn in the 10-K filed 1 Feb 2032, then $3.25bn in the 10-K/A filed 1 May 2032. The latest figure is used."


def test_check_list(spark, frameworks):
    rollup = spark.createDataFrame([("generic", "derivation:net_income", 3, 1, 0), ("generic", "sign", 2, 0, 0), ("generic", "scale_break", 0, 0, 0)], "framework string, check_id string, passed int, failed int, not_evaluable int")
    formulas = metric_spec(spark, frameworks).select("framework", "metric_id", "derivation")
    got = {r.check_id: (r.label, r.description) for r in display.check_list(rollup, display.name_table(spark, frameworks), formulas).collect()}
    assert got == {
        "derivation:net_income": ("Net income adds up", "Where the company reports net income itself, it equals pre-tax income minus income tax expense."),
        "sign": (got["sign"][0], "Figures that cannot be negative are not negative."),
    }
