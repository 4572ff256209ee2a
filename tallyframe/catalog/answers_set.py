"""Answers other than a value: what is refused, mixed up, not run yet, or stands in for something else."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derive, entities
from ..plans import forecast, views
from .common import annual, annual_current, dbl, frameworks, sql
from .documents_set import _read
from .forecast_set import _TREND, HORIZON, _bank_facts


def mixed_currencies(spark, sf):
    """A formula over inputs in two currencies is refused; the costs of some companies are in pounds in even years."""
    facts = annual_current(spark, sf, ["revenue", "cost_of_revenue"])
    co = F.substring("company_id", 4, 20).cast("long")
    foreign = (F.col("metric_id") == "cost_of_revenue") & (co % 4 == 0) & (F.col("fiscal_year") % 2 == 0)
    events = derive.formula_events(facts.withColumn("currency", F.when(foreign, "GBP").otherwise(F.col("currency"))), frameworks())
    return events.filter("metric_id = 'gross_profit'").select("company_id", "fiscal_year", "outcome")


MIXED_CURRENCIES = sql("SELECT company_id, y AS fiscal_year, CASE WHEN co % 4 = 0 AND y % 2 = 0 THEN 'mixed_currency' ELSE 'derived' END AS outcome FROM ann")


def profile_violations(spark, sf):
    """Configured companies against what the regulator says, and the addresses of structured data against the company."""
    c = _read(spark, sf, "customer")
    k = F.col("c_custkey")
    ten = lambda n: F.lpad(n.cast("string"), 10, "0")
    month = lambda n: (n % 12 + 1).cast("int")
    who = c.select(k.cast("string").alias("company_id"), F.when(k % 7 != 0, ten(k)).alias("cik"), F.concat(F.lit("T"), k.cast("string")).alias("ticker"), month(k).alias("fye_month"))
    facts = F.concat(F.lit("https://data.sec.gov/api/xbrl/companyfacts/CIK"), ten(F.when(k % 4 == 0, k + 1).otherwise(k)), F.lit(".json"))
    url = F.when(k % 9 == 0, F.concat(F.lit("https://data.sec.gov/api/other/"), k.cast("string"))).otherwise(facts)
    sources = c.select(k.cast("string").alias("company_id"), F.when(k % 5 == 0, "annual_reports").otherwise("structured_filings").alias("kind"), url.alias("url"), F.lit(None).cast("string").alias("path"))
    tickers = F.when(k % 10 == 0, F.array().cast("array<string>")).when(k % 8 == 0, F.array(F.lit("OTHER"))).otherwise(F.array(F.concat(F.lit("T"), k.cast("string"))))
    profiles = c.select(k.cast("string").alias("company_id"), ten(F.when(k % 6 == 0, k + 2).otherwise(k)).alias("cik"), tickers.alias("tickers"), month(F.when(k % 11 == 0, k + 1).otherwise(k)).alias("fye_month"))
    return entities.config_violations(who, sources, profiles).select("company_id", "rule")


PROFILE_VIOLATIONS = """
WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS company_id FROM customer)
SELECT company_id, 'unsupported_endpoint' AS rule FROM c WHERE k % 9 = 0 AND k % 5 <> 0
UNION ALL SELECT company_id, 'structured_source_misplaced' FROM c WHERE k % 5 = 0 AND k % 9 <> 0
UNION ALL SELECT company_id, 'cik_required' FROM c WHERE k % 7 = 0 AND k % 9 <> 0 AND k % 5 <> 0
UNION ALL SELECT company_id, 'cik_mismatch' FROM c WHERE k % 4 = 0 AND k % 7 <> 0 AND k % 9 <> 0 AND k % 5 <> 0
UNION ALL SELECT company_id, 'profile_cik_mismatch' FROM c WHERE k % 6 = 0 AND k % 7 <> 0
UNION ALL SELECT company_id, 'ticker_not_listed' FROM c WHERE k % 8 = 0 AND k % 10 <> 0
UNION ALL SELECT company_id, 'fiscal_year_end_differs' FROM c WHERE k % 11 = 0
"""


def stage_answers(spark, sf):
    """What a reader gets who asks for a stage: its rows or the sentence that it has not run, never an empty result."""
    c = _read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("company_id"))
    done = F.slice(F.array(*[F.lit(s) for s in views.STAGES]), F.lit(1), (F.col("k") % 5).cast("int"))
    manifests = c.select("company_id", F.explode(done).alias("stage"))
    return views.stage_answers(c.select("company_id", F.explode(F.array(*[F.lit(s) for s in views.STAGES])).alias("stage")), manifests)


STAGE_ANSWERS = """
SELECT CAST(c_custkey AS VARCHAR) AS company_id, s.s AS stage, c_custkey % 5 >= s.n AS ran, CASE WHEN c_custkey % 5 < s.n THEN c_custkey || ': run `' || s.s || '` first' END AS answer
FROM customer CROSS JOIN (VALUES (1, 'ingest'), (2, 'quality'), (3, 'analyze'), (4, 'forecast')) s(n, s)
"""


def forecast_wide(spark, sf):
    """Scenario by year for each metric, as a reader gets the table."""
    facts = annual(spark, sf, ["operating_cash_flow", "capital_expenditure", "operating_income"])
    run = forecast.run_forecast(facts, frameworks(), years=HORIZON, only=("free_cash_flow",))
    years = [r.fiscal_year for r in run.values.select("fiscal_year").distinct().orderBy("fiscal_year").collect()]  # a handful
    wide = views.forecast_table(run.values, years)
    return wide.select("company_id", "metric_id", "scenario", "scenario_order", *[dbl(c, 1) for c in wide.columns if c.startswith("FY")]).unpivot(
        ["company_id", "metric_id", "scenario", "scenario_order"], [c for c in wide.columns if c.startswith("FY")], "year", "value").filter("value is not null")


FORECAST_WIDE = sql(
    """
SELECT company_id, name AS metric_id, 'base' AS scenario, 0 AS scenario_order, 'FY' || (base_y + k) AS year, round(v, 1) AS value FROM path
UNION ALL SELECT company_id, 'free_cash_flow', 'base', 0, 'FY' || (any_value(base_y) + k), round(max(v) FILTER (name = 'operating_cash_flow') - max(v) FILTER (name = 'capital_expenditure'), 1) FROM path GROUP BY company_id, k
""",
    "flows AS (SELECT company_id, 'operating_cash_flow' AS name, y, CAST(net AS DOUBLE) AS v FROM ann UNION ALL SELECT company_id, 'capital_expenditure', y, CAST(tax AS DOUBLE) FROM ann)",
    _TREND,
)


def fallback_notes(spark, sf):
    """Metrics that are estimated from their own trend, with the inputs that are missing, in words."""
    run = forecast.run_forecast(_bank_facts(spark, sf), frameworks("banks"), years=HORIZON, only=("revenue",))
    return views.fallback_notes(run.frame, run.plans, frameworks("banks"))


FALLBACK_NOTES = sql(
    """
SELECT company_id, 'net_interest_income' AS metric_id, 'Net interest income' AS label,
  'Net interest income is estimated from its own recent trend because average interest-earning assets and net interest margin aren''t disclosed in the SEC''s structured financial data.' AS text
FROM ann GROUP BY company_id
"""
)


QUERIES = {
    "mixed_currencies": (mixed_currencies, MIXED_CURRENCIES),
    "profile_violations": (profile_violations, PROFILE_VIOLATIONS),
    "stage_answers": (stage_answers, STAGE_ANSWERS),
    "forecast_wide": (forecast_wide, FORECAST_WIDE),
    "fallback_notes": (fallback_notes, FALLBACK_NOTES),
}
