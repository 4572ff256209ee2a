"""Seeds, the assumption ladder, scenario projections and fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, lineage
from ..plans import forecast, projection, views
from ..session import stage
from ..sources import tables
from .common import annual, dbl, frameworks, sql
from .facts_set import _SWING

HORIZON = 3


def _seeds(spark, sf, metrics, space):
    found = forecast.seed_candidates(forecast.annual_points(annual(spark, sf, metrics, formulas=False)))
    return found.filter(F.col("space") == space).select(
        "company_id", "name", F.when(F.col("observations") > 0, F.round("value", 6)).alias("value"), "observations", F.size("source_fact_ids").alias("n_facts")
    )


def growth_seed(spark, sf):
    return _seeds(spark, sf, ["revenue", "operating_income"], "growth")


_SERIES = "series AS (SELECT company_id, 'revenue' AS name, y, v FROM rev UNION ALL SELECT company_id, 'operating_income', y, s FROM sw)"
_SEED = """seed AS (SELECT company_id, name, median(g) AS value, CAST(count(g) AS INTEGER) AS observations, CAST(count(g) + count(*) FILTER (g IS NOT NULL AND NOT follows) AS INTEGER) AS n_facts FROM (
  SELECT *, coalesce(lag(g) OVER (PARTITION BY company_id, name ORDER BY y) IS NOT NULL, false) AS follows FROM (
    SELECT company_id, name, y, CASE WHEN y > base_y - 3 AND pv > 0 AND v > 0 AND py = y - 1 THEN v / pv - 1 END AS g FROM (
      SELECT *, lag(v) OVER w AS pv, lag(y) OVER w AS py, max(y) OVER (PARTITION BY company_id) AS base_y FROM series WINDOW w AS (PARTITION BY company_id, name ORDER BY y)))) GROUP BY 1, 2)"""
GROWTH_SEED = sql("SELECT company_id, name, round(value, 6) AS value, observations, n_facts FROM seed", _SWING, _SERIES, _SEED)


def level_seed(spark, sf):
    return _seeds(spark, sf, ["revenue", "operating_income"], "level")


LEVEL_SEED = sql(
    """
SELECT company_id, name, round(median(v), 6) AS value, CAST(count(*) AS INTEGER) AS observations, CAST(count(*) AS INTEGER) AS n_facts
FROM (SELECT *, max(y) OVER (PARTITION BY company_id) AS base_y FROM series) WHERE y > base_y - 3 GROUP BY 1, 2
""",
    _SWING,
    _SERIES,
)

_LADDER = ("scenario", "analyst_assumption", "management_guidance", "consensus", "historical")


def assumption_ladder(spark, sf):
    """Customers demand a value per year and scenario; their orders declare it on different rungs."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    kind = F.element_at(F.array(*[F.lit(k) for k in _LADDER]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    raw = orders.select(
        F.col("o_custkey").cast("string").alias("company_id"), F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("n"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("value"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("FY"), (2002 + F.col("o_orderkey") % 2).cast("string"))).alias("period"),
        kind.alias("type"), F.when(kind == "scenario", F.when(F.col("o_orderkey") % 2 == 0, "bull").otherwise("bear")).alias("scenario"),
    )
    # One declaration per key, rung, year and scenario, as the authored file requires.
    declared = raw.groupBy("company_id", "key", "type", "period", "scenario").agg(F.max_by(F.struct("value"), "n").alias("v")).select(
        "company_id", "key", "type", "period", "scenario", "v.value", F.lit(None).cast("string").alias("source_document_id"))
    scenarios, years = F.array(*[F.lit(x) for x in ("base", "bull", "bear")]), F.array(F.lit(2002), F.lit(2003))
    demands = raw.select("company_id", "key").distinct().withColumn("scenario", F.explode(scenarios)).withColumn("fiscal_year", F.explode(years))
    return forecast.resolve_assumptions(demands, declared).select("company_id", "scenario", "key", "fiscal_year", "value", "type", "pinned", "reason")


ASSUMPTION_LADDER = """
WITH raw AS (SELECT CAST(o_custkey AS VARCHAR) AS company_id, o_orderpriority AS key, o_orderkey AS n, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS value,
   CASE WHEN o_orderkey % 3 = 0 THEN 2002 + o_orderkey % 2 END AS pin, o_orderkey % 5 AS rung, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'bull' ELSE 'bear' END END AS scen FROM orders),
one AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY company_id, key, rung, pin, scen ORDER BY n DESC) = 1),
asked AS (SELECT DISTINCT company_id, key, s.s AS scenario, y.y AS fiscal_year FROM raw CROSS JOIN (VALUES ('base'), ('bull'), ('bear')) s(s) CROSS JOIN (VALUES (2002), (2003)) y(y)),
best AS (SELECT a.*, o.value, o.rung, o.pin, row_number() OVER (PARTITION BY a.company_id, a.key, a.scenario, a.fiscal_year ORDER BY o.rung NULLS LAST, o.pin IS NULL) AS rn
  FROM asked a LEFT JOIN one o ON o.company_id = a.company_id AND o.key = a.key AND (o.scen IS NULL OR o.scen = a.scenario) AND (o.pin IS NULL OR o.pin = a.fiscal_year))
SELECT company_id, scenario, key, fiscal_year, value, CASE rung WHEN 0 THEN 'scenario' WHEN 1 THEN 'analyst_assumption' WHEN 2 THEN 'management_guidance' WHEN 3 THEN 'consensus' WHEN 4 THEN 'historical' END AS type,
  CASE WHEN rung IS NOT NULL THEN pin IS NOT NULL END AS pinned,
  CASE WHEN rung IS NULL THEN 'assumption_missing:' || key WHEN value IS NULL THEN 'assumption_unset:' || key END AS reason
FROM best WHERE rn = 1
"""


def _shown(events, places=2):
    return events.select("company_id", "scenario", "metric_id", "fiscal_year", dbl("value", places), "method", "reason", "currency")


_CUR = "CASE WHEN CAST(substr(company_id, 4) AS INTEGER) % 10 = 3 THEN 'EUR' ELSE 'USD' END"


def forecast_base(spark, sf):
    facts = annual(spark, sf, ["operating_cash_flow", "capital_expenditure", "operating_income"], fw=projection.narrowed(frameworks(), ("free_cash_flow",)))
    run = forecast.run_forecast(facts, frameworks(), years=HORIZON, only=("free_cash_flow",))
    return _shown(run.events, 1)


_TREND = """trend AS (SELECT company_id, name, y, v, max(y) OVER (PARTITION BY company_id) AS base_y, lag(v) OVER (PARTITION BY company_id, name ORDER BY y) AS pv FROM flows),
g AS (SELECT company_id, name, median(v / pv - 1) FILTER (y > base_y - 3 AND pv > 0 AND v > 0) AS g, max(v) FILTER (y = base_y) AS base, any_value(base_y) AS base_y FROM trend GROUP BY 1, 2),
path AS (SELECT g.*, k.k, base * pow(1 + g, k.k) AS v FROM g CROSS JOIN (VALUES (0), (1), (2), (3)) k(k))"""
FORECAST_BASE = sql(
    f"""
SELECT company_id, 'base' AS scenario, name AS metric_id, base_y + k AS fiscal_year, round(v, 1) AS value, CASE WHEN k = 0 THEN 'actual' ELSE 'growth' END AS method, CAST(NULL AS VARCHAR) AS reason, {_CUR} AS currency FROM path
UNION ALL SELECT company_id, 'base', 'free_cash_flow', any_value(base_y) + k, round(max(v) FILTER (name = 'operating_cash_flow') - max(v) FILTER (name = 'capital_expenditure'), 1),
  CASE WHEN k = 0 THEN 'actual' ELSE 'derivation' END, NULL, {_CUR} FROM path GROUP BY company_id, k
""",
    "flows AS (SELECT company_id, 'operating_cash_flow' AS name, y, CAST(net AS DOUBLE) AS v FROM ann UNION ALL SELECT company_id, 'capital_expenditure', y, CAST(tax AS DOUBLE) FROM ann)",
    _TREND,
)


def forecast_lines(spark, sf):
    """Projected lines as a reader gets them: one per metric with its points in order."""
    facts = annual(spark, sf, ["operating_cash_flow", "capital_expenditure", "operating_income"], fw=projection.narrowed(frameworks(), ("free_cash_flow",)))
    run = forecast.run_forecast(facts, frameworks(), years=HORIZON, only=("free_cash_flow",))
    lines = views.forecast_view(run.values, run.frame, run.plans)
    last = F.element_at("points", -1)
    return lines.select("company_id", "scenario", "metric_id", "currency", F.size("points").alias("n_points"), last["fiscal_year"].alias("last_year"), F.round(last["value"], 1).alias("last_value"), "fallback")


FORECAST_LINES = sql(
    f"""
SELECT company_id, 'base' AS scenario, name AS metric_id, {_CUR} AS currency, 4 AS n_points, base_y + 3 AS last_year, round(v, 1) AS last_value, false AS fallback FROM path WHERE k = 3
UNION ALL SELECT company_id, 'base', 'free_cash_flow', {_CUR}, 4, any_value(base_y) + 3, round(max(v) FILTER (name = 'operating_cash_flow') - max(v) FILTER (name = 'capital_expenditure'), 1), false FROM path WHERE k = 3 GROUP BY company_id
""",
    "flows AS (SELECT company_id, 'operating_cash_flow' AS name, y, CAST(net AS DOUBLE) AS v FROM ann UNION ALL SELECT company_id, 'capital_expenditure', y, CAST(tax AS DOUBLE) FROM ann)",
    _TREND,
)


def traceable_ids(spark, sf):
    """Every id a reader can ask the origin of, counted by what it stands for."""
    facts = stage(annual(spark, sf, ["operating_cash_flow", "capital_expenditure"]), "facts")
    gated = facts.withColumn("blocked", F.lit(None).cast("string")).withColumn("flags", F.array().cast("array<string>"))
    values = analytics.analytic_values(analytics.analytic_events(analytics.annual_frame(gated), frameworks(), ["operating_cash_flow_growth"]))
    run = forecast.run_forecast(facts, frameworks(), years=HORIZON, only=("operating_cash_flow",))
    return views.traceable_ids(facts, values, run.values).groupBy(F.substring_index("id", "_", 1).alias("kind")).agg(F.count("*").alias("n"))


TRACEABLE = sql(
    """
SELECT 'fact' AS kind, 3 * count(*) AS n FROM ann
UNION ALL SELECT 'ana', count(*) FROM (SELECT y, net, lag(net) OVER w AS pn, lag(y) OVER w AS py FROM ann WINDOW w AS (PARTITION BY co ORDER BY y)) WHERE py = y - 1 AND pn > 0 AND net > 0
UNION ALL SELECT 'fcv', 4 * count(DISTINCT co) FROM ann
"""
)


def _driver_inputs(spark, sf):
    metrics, rates = ["revenue", "operating_income", "pre_tax_income", "income_tax_expense"], ["operating_margin", "pretax_conversion", "effective_tax_rate"]
    facts = stage(annual(spark, sf, metrics, fw=projection.narrowed(frameworks(), ("net_income",), tuple(rates))), "facts")
    gated = facts.withColumn("blocked", F.lit(None).cast("string")).withColumn("flags", F.array().cast("array<string>"))
    events = analytics.analytic_events(analytics.annual_frame(gated), frameworks(), rates)
    return facts, lineage.facts_under(stage(analytics.analytic_values(events), "values"))


def _driver_run(spark, sf):
    facts, rates = _driver_inputs(spark, sf)
    return forecast.run_forecast(facts, frameworks(), rates=rates, years=HORIZON, only=("net_income",))


def forecast_drivers(spark, sf):
    return _shown(_driver_run(spark, sf).events, 1)


_RATES = """r0 AS (SELECT a.company_id, a.co, a.y, v AS rev, s AS op, CAST(net - disc AS DOUBLE) AS pre, CAST(tax AS DOUBLE) AS tax, max(a.y) OVER (PARTITION BY a.co) AS base_y, lag(v) OVER (PARTITION BY a.co ORDER BY a.y) AS prev
  FROM ann a JOIN rev USING (co, y) JOIN sw USING (co, y)),
rt AS (SELECT company_id, any_value(base_y) AS base_y, median(rev / prev - 1) FILTER (y > base_y - 3 AND prev > 0 AND rev > 0) AS g, median(op / rev) FILTER (y > base_y - 3 AND rev > 0) AS om, median(pre / op) FILTER (y > base_y - 3 AND op > 0) AS pc,
  median(tax / pre) FILTER (y > base_y - 3 AND pre > 0) AS tr, max(rev) FILTER (y = base_y) AS b_rev, max(op) FILTER (y = base_y) AS b_op, max(pre) FILTER (y = base_y) AS b_pre, max(tax) FILTER (y = base_y) AS b_tax FROM r0 GROUP BY 1),
fc AS (SELECT *, b_rev * pow(1 + g, k) AS f_rev FROM rt CROSS JOIN (VALUES (1), (2), (3)) k(k)),
out AS (SELECT company_id, m.m AS metric_id, base_y AS fiscal_year, CASE m.m WHEN 'revenue' THEN b_rev WHEN 'operating_income' THEN b_op WHEN 'pre_tax_income' THEN b_pre WHEN 'income_tax_expense' THEN b_tax ELSE b_pre - b_tax END AS value, 'actual' AS method, NULL AS reason
  FROM rt CROSS JOIN (VALUES ('revenue'), ('operating_income'), ('pre_tax_income'), ('income_tax_expense'), ('net_income')) m(m)
 UNION ALL SELECT company_id, 'revenue', base_y + k, f_rev, 'growth', NULL FROM fc UNION ALL SELECT company_id, 'operating_income', base_y + k, f_rev * om, 'driver_formula', NULL FROM fc
 UNION ALL SELECT company_id, 'pre_tax_income', base_y + k, f_rev * om * pc, 'driver_formula', CASE WHEN pc IS NULL THEN 'assumption_missing:rate.pretax_conversion' END FROM fc
 UNION ALL SELECT company_id, 'income_tax_expense', base_y + k, f_rev * om * pc * tr, 'driver_formula', CASE WHEN pc IS NULL THEN 'input_not_projected:pre_tax_income' END FROM fc
 UNION ALL SELECT company_id, 'net_income', base_y + k, f_rev * om * pc * (1 - tr), 'derivation', CASE WHEN pc IS NULL THEN 'input_not_projected:income_tax_expense' END FROM fc)"""
FORECAST_DRIVERS = sql(
    f"SELECT company_id, 'base' AS scenario, metric_id, fiscal_year, round(value, 1) AS value, method, reason, {_CUR} AS currency FROM out", _SWING, _RATES
)


def not_projected(spark, sf):
    return _driver_run(spark, sf).not_projected.groupBy("metric_id", "reason").agg(F.sum("n").alias("n"))


NOT_PROJECTED = sql("SELECT metric_id, reason, count(*) AS n FROM out WHERE reason IS NOT NULL GROUP BY 1, 2", _SWING, _RATES)


def unseeded_assumptions(spark, sf):
    facts, rates = _driver_inputs(spark, sf)
    return forecast.unseeded(facts, frameworks(), rates=rates, only=("net_income",))


UNSEEDED = sql(
    "SELECT company_id, 'rate.pretax_conversion' AS key, CASE WHEN any_op IS NULL THEN 'analytic was not computed in the historical analysis: pretax_conversion' ELSE 'no traceable values in FY' || (base_y - 2) || '-FY' || base_y || ': pretax_conversion' END AS reason "
    "FROM rt JOIN (SELECT company_id, max(op) FILTER (op > 0) AS any_op FROM r0 GROUP BY 1) USING (company_id) WHERE pc IS NULL", _SWING, _RATES
)


def forecast_scenarios(spark, sf):
    """Scenario, analyst and unset assumptions over a seeded base, on one growth metric."""
    facts = annual(spark, sf, ["revenue"], formulas=False)
    who = tables.entities(spark, sf).select("company_id", F.substring("company_id", 4, 20).cast("long").alias("co"))
    text = lambda v=None: F.lit(v).cast("string")
    row = lambda value, period, kind, scenario: F.struct(value.cast("double").alias("value"), period.alias("period"), text(kind).alias("type"), text(scenario).alias("scenario"))
    declared = F.array_compact(F.array(
        row(F.lit(0.2), text(), "scenario", "bull"), row(F.lit(-0.1), text("FY2003"), "scenario", "bear"),
        F.when(F.col("co") % 3 == 0, row(F.lit(0.05), text(), "analyst_assumption", None)),
        F.when(F.col("co") % 7 == 0, row(F.lit(None), text("FY2002"), "analyst_assumption", None)),
        F.when(F.col("co") % 4 == 0, row(F.lit(0.5), text(), "consensus", None)),
    ))
    analyst = who.select("company_id", F.explode(declared).alias("a")).select(
        "company_id", F.lit("growth.revenue").alias("key"), "a.value", F.lit("ratio").alias("unit"), "a.period", "a.type", "a.scenario", F.lit("authored").alias("description"),
        F.lit("test of the ladder").alias("rationale"), text().alias("source_document_id"), F.array().cast("array<string>").alias("source_fact_ids"))
    scenarios = who.select("company_id", F.explode(F.array(F.lit("bull"), F.lit("bear"))).alias("scenario"))
    run = forecast.run_forecast(facts, frameworks(), analyst=analyst, scenarios=scenarios, years=2, only=("revenue",))
    return run.events.select("company_id", "scenario", "fiscal_year", dbl("value", 1), "method", "reason", F.array_join("assumption_types", ",").alias("types"))


FORECAST_SCENARIOS = sql(
    """
SELECT company_id, scenario, 2001 AS fiscal_year, round(base, 1) AS value, 'actual' AS method, CAST(NULL AS VARCHAR) AS reason, '' AS types FROM a
UNION ALL SELECT company_id, scenario, 2002, round(base * (1 + a2), 1), 'growth', CASE WHEN a2 IS NULL THEN 'assumption_unset:growth.revenue' END, t2 FROM a
UNION ALL SELECT company_id, scenario, 2003, round(base * (1 + a2) * (1 + a3), 1), 'growth', CASE WHEN a2 IS NULL THEN 'prior_year_not_projected:revenue' END, t3 FROM a
""",
    "flows AS (SELECT company_id, 'revenue' AS name, y, v FROM rev)",
    _TREND,
    """c AS (SELECT *, CAST(substr(company_id, 4) AS INTEGER) AS co FROM g),
low AS (SELECT *, CASE WHEN co % 3 = 0 THEN 0.05 WHEN co % 4 = 0 THEN 0.5 ELSE g END AS v, CASE WHEN co % 3 = 0 THEN 'analyst_assumption' WHEN co % 4 = 0 THEN 'consensus' ELSE 'historical' END AS t FROM c),
a AS (SELECT low.*, s.s AS scenario, CASE WHEN s.s = 'bull' THEN 0.2 WHEN co % 7 = 0 THEN NULL ELSE v END AS a2, CASE WHEN s.s = 'bull' THEN 'scenario' WHEN co % 7 = 0 THEN 'analyst_assumption' ELSE t END AS t2,
  CASE s.s WHEN 'bull' THEN 0.2 WHEN 'bear' THEN -0.1 ELSE v END AS a3, CASE WHEN s.s IN ('bull', 'bear') THEN 'scenario' ELSE t END AS t3 FROM low CROSS JOIN (VALUES ('base'), ('bull'), ('bear')) s(s))""",
)


def _bank_facts(spark, sf):
    return annual(spark, sf, ["net_interest_income", "noninterest_income", "noninterest_expense"], framework="banks")


def fallback_marks(spark, sf):
    run = forecast.run_forecast(_bank_facts(spark, sf), frameworks("banks"), years=HORIZON, only=("revenue",))
    return run.events.select("company_id", "metric_id", "fiscal_year", dbl("value", 2), "method", "reason", F.array_join("fallback_for", ",").alias("fallback_for"))


FALLBACK = sql(
    """
SELECT company_id, name AS metric_id, base_y + k AS fiscal_year, round(v, 2) AS value, CASE WHEN k = 0 THEN 'actual' ELSE 'growth' END AS method, CAST(NULL AS VARCHAR) AS reason,
  CASE WHEN k > 0 AND name = 'net_interest_income' THEN name ELSE '' END AS fallback_for FROM path
UNION ALL SELECT company_id, 'revenue', any_value(base_y) + k, round(sum(v), 2), CASE WHEN k = 0 THEN 'actual' ELSE 'derivation' END, NULL, CASE WHEN k > 0 THEN 'net_interest_income' ELSE '' END FROM path GROUP BY company_id, k
""",
    "flows AS (SELECT company_id, 'net_interest_income' AS name, y, CAST(net AS DOUBLE) AS v FROM ann UNION ALL SELECT company_id, 'noninterest_income', y, CAST(disc AS DOUBLE) FROM ann)",
    _TREND,
)


def projection_plan(spark, sf):
    """Which plan each company uses: banks without average balances fall back, and say so."""
    fw = frameworks("banks")
    frame = forecast.base_frame(forecast.annual_points(_bank_facts(spark, sf)), fw)
    plan = projection.plan_table(spark, projection.all_plans(fw))
    return frame.select("company_id", "signature").join(plan, "signature").groupBy("company_id", "signature", "method").agg(F.count("*").alias("n"), F.count_if("fallback").alias("fallbacks"))


PROJECTION_PLAN = sql(
    """
SELECT company_id, 'banks/net_interest_income_engine' AS signature, m.m AS method, m.n, m.f AS fallbacks FROM (SELECT DISTINCT company_id FROM ann)
CROSS JOIN (VALUES ('growth', 9, 1), ('level', 1, 0), ('driver_formula', 3, 0), ('derivation', 4, 0)) m(m, n, f)
"""
)

QUERIES = {
    "growth_seed": (growth_seed, GROWTH_SEED),
    "level_seed": (level_seed, LEVEL_SEED),
    "assumption_ladder": (assumption_ladder, ASSUMPTION_LADDER),
    "forecast_base": (forecast_base, FORECAST_BASE),
    "forecast_lines": (forecast_lines, FORECAST_LINES),
    "traceable_ids": (traceable_ids, TRACEABLE),
    "forecast_drivers": (forecast_drivers, FORECAST_DRIVERS),
    "forecast_scenarios": (forecast_scenarios, FORECAST_SCENARIOS),
    "not_projected": (not_projected, NOT_PROJECTED),
    "unseeded_assumptions": (unseeded_assumptions, UNSEEDED),
    "fallback_marks": (fallback_marks, FALLBACK),
    "projection_plan": (projection_plan, PROJECTION_PLAN),
}
