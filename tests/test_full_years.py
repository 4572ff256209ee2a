from helpers import SF
from pyspark.sql import functions as F

from tallyframe.catalog import common
from tallyframe.operators import extract
from tallyframe.plans import forecast
from tallyframe.sources import tables

METRICS = ["revenue", "operating_income", "diluted_shares", "cash_and_restricted_cash"]


def test_full_years_are_made_without_the_other_quarters(spark):
    whole, years = (tables.observations(spark, SF, METRICS, full_years=f) for f in (False, True))
    assert years.filter("form = '10-Q'").isEmpty() and not whole.filter("form = '10-Q'").isEmpty()
    assert years.exceptAll(whole.filter("form <> '10-Q'")).isEmpty() and whole.filter("form <> '10-Q'").exceptAll(years).isEmpty()
    facts = lambda full: extract.to_facts(extract.disclosures(common.mapped(spark, SF, METRICS, full_years=full).filter("fiscal_period = 'FY'"))).select(F.sort_array(F.array("fact_id", "notes")))
    assert facts(True).exceptAll(facts(False)).isEmpty() and facts(False).exceptAll(facts(True)).isEmpty()


def test_what_has_no_seed_is_told_without_a_projection(spark, monkeypatch):
    facts = common.annual(spark, SF, ["operating_cash_flow", "capital_expenditure"])
    told = lambda df: sorted(tuple(r) for r in df.collect())
    whole = told(forecast.run_forecast(facts, common.frameworks(), years=1, only=("net_income",)).unseeded)
    monkeypatch.setattr(forecast, "resolve_assumptions", None)
    assert whole and told(forecast.unseeded(facts, common.frameworks(), only=("net_income",))) == whole
