"""What forecasts no longer work out: derivations and seeds nobody reads, facts of values that do not stay, dates over and over."""

from helpers import SF
from pyspark.sql import functions as F

from tallyframe.catalog import common, forecast_set
from tallyframe.functions import calendar
from tallyframe.operators import extract
from tallyframe.plans import forecast, projection
from tallyframe.sources import specs, tables

METRICS = ["revenue", "operating_income", "pre_tax_income", "income_tax_expense", "total_assets"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_current_values_are_picked_before_they_are_facts(spark):
    mapped = common.mapped(spark, SF, METRICS, ("gap", "scale"))
    whole, early = extract.current_facts(extract.to_facts(extract.disclosures(mapped))), extract.current_of(common.mapped(spark, SF, METRICS, ("gap", "scale"), compacted=False))
    assert whole.columns == early.columns
    told = lambda df: df.select(F.to_json(F.struct(*df.columns)).alias("row"))
    assert not early.isEmpty() and told(whole).exceptAll(told(early)).isEmpty() and told(early).exceptAll(told(whole)).isEmpty()
    assert plan(early).count("Window") < plan(whole).count("Window")


def test_periods_are_told_from_shared_columns(spark):
    rows = [(s, e, m, c) for s, e in ((None, "2020-12-31"), ("2020-01-01", "2020-12-31"), ("2020-01-01", "2020-03-31"), ("2020-01-01", "2020-06-30"), ("2020-05-01", "2020-01-31"), ("2020-01-01", "2020-01-03"), ("2020-01-01", None), (None, None)) for m in (12, 6, None) for c in ("end_year", "start_year")]
    df = spark.createDataFrame(rows, "s string, e string, fye_month int, convention string").select(F.to_date("s").alias("period_start"), F.to_date("e").alias("period_end"), "fye_month", "convention")
    both = calendar.with_period(df).withColumn("again", calendar.classify(*[F.col(c) for c in ("period_start", "period_end", "fye_month", "convention")]))
    assert all(r.period == r.again for r in both.collect())
    mapped = extract.map_observations(tables.observations(spark, SF, ["revenue"]), tables.entities(spark, SF), common.frameworks())
    assert plan(mapped).count("date_sub(") < 5


def test_only_what_a_forecast_reads_is_derived_and_seeded(spark, make_facts):
    for name, framework in specs.shipped().items():
        target = next(m for m, s in framework.metrics.items() if s.derivation)
        few = projection.narrowed({name: framework}, (target,))[name]
        assert few.metrics.keys() == framework.metrics.keys() and few.metrics[target].derivation
        read = {m for p in projection.all_plans({name: framework}, (target,)) for m in p.rules}
        assert all(few.metrics[m].derivation == framework.metrics[m].derivation for m in read)
    few = projection.narrowed(common.frameworks(), ("free_cash_flow",))["generic"]
    assert [m for m, s in few.metrics.items() if s.derivation] == ["free_cash_flow"]
    points = forecast.annual_points(make_facts([("revenue", "FY2029", 4), ("revenue", "FY2030", 5), ("total_assets", "FY2030", 9)]))
    every, some = forecast.seed_candidates(points), forecast.seed_candidates(points, wanted={"growth": {"revenue"}})
    assert some.collect() == every.filter("space = 'growth' AND name = 'revenue'").collect() and every.count() == 4
    assert forecast_set.forecast_lines(spark, SF).count() > 0


def test_drivers_derive_only_what_they_read(spark, monkeypatch):
    given = []
    whole = forecast_set.annual
    monkeypatch.setattr(forecast_set, "annual", lambda *args, **named: given.append(named.get("fw")) or whole(*args, **named))
    forecast_set._driver_inputs(spark, SF)
    assert [m for m, s in given[0]["generic"].metrics.items() if s.derivation] == ["net_income"]
