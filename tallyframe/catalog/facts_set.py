"""Extraction, derivation, checks, analytics and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, display, numeric
from ..operators import analytics, checks, constraints, derive, extract, summary
from ..session import stage
from ..sources import specs, tables
from .common import annual, annual_current, current, dbl, disclosed, extended, frameworks, label, mapped, no_issues, outcome_counts, sql

CORE = ["revenue", "cost_of_revenue"]


# ---- facts ------------------------------------------------------------------------------------------------------


def facts_current(spark: SparkSession, sf: str) -> DataFrame:
    return current(spark, sf, ["revenue"]).select("company_id", label(), dbl("value"), "unit", "concept", "form", "filed", "accession")


FACTS_CURRENT = sql(
    """
SELECT company_id, CASE i WHEN 1 THEN 'Q1-' || y WHEN 2 THEN 'H1-' || y ELSE '9M-' || y END AS period, round(CAST(net AS DOUBLE), 4) AS value,
  CASE WHEN co % 10 = 3 THEN 'EUR' ELSE 'USD' END AS unit, concept, '10-Q' AS form, last_day(make_date(y, 3*i, 1)) + 40 AS filed,
  printf('%010d-%02d-%06d', co, year(last_day(make_date(y, 3*i, 1)) + 40) % 100, y*10 + i) AS accession
FROM (SELECT *, CASE WHEN co % 4 = 0 AND y < 1998 THEN 'us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax' ELSE 'us-gaap:Revenues' END AS concept FROM ytd) WHERE i < 4
UNION ALL
SELECT company_id, 'FY' || y, round(CAST(CASE WHEN re THEN net_r ELSE net END AS DOUBLE), 4), CASE WHEN co % 10 = 3 THEN 'EUR' ELSE 'USD' END,
  CASE WHEN co % 4 = 0 AND y < 1998 THEN 'us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax' ELSE 'us-gaap:Revenues' END, '10-K',
  make_date(y + CASE WHEN re THEN 2 ELSE 1 END, 2, 20),
  printf('%010d-%02d-%06d', co, (y + CASE WHEN re THEN 2 ELSE 1 END) % 100, y*10 + CASE WHEN re THEN 5 ELSE 4 END)
FROM (SELECT *, co % 5 = 0 AND net <> net_r AS re FROM ann)
"""
)


def restatements(spark, sf):
    return extract.restatements(disclosed(spark, sf, ["revenue"])).select("company_id", "period", "version", dbl("value"), "unit", "form", "filed")


RESTATEMENTS = sql(
    """
SELECT company_id, 'FY' || y AS period, v.v AS version, round(CAST(CASE v.v WHEN 1 THEN net ELSE net_r END AS DOUBLE), 4) AS value,
  CASE WHEN co % 10 = 3 THEN 'EUR' ELSE 'USD' END AS unit, '10-K' AS form, make_date(y + v.v, 2, 20) AS filed
FROM ann CROSS JOIN (VALUES (1), (2)) v(v) WHERE co % 5 = 0 AND net <> net_r
"""
)


def repeated_disclosures(spark, sf):
    facts = extract.to_facts(disclosed(spark, sf, CORE)).filter("fiscal_period = 'FY'")
    return facts.select("company_id", "metric_id", "fiscal_year", dbl("value"), "notes")


REPEATED = sql(
    """
SELECT company_id, 'revenue' AS metric_id, y AS fiscal_year, round(CAST(v AS DOUBLE), 4) AS value,
  'concept rank ' || CASE WHEN co % 4 = 0 AND y < 1998 THEN '2' ELSE '1' END || ' of 3' || CASE WHEN same THEN '; repeated in 1 later filing(s)' ELSE '' END AS notes
FROM (SELECT *, net AS v, NOT (co % 5 = 0 AND net <> net_r) AS same FROM ann
      UNION ALL SELECT *, net_r AS v, false AS same FROM ann WHERE co % 5 = 0 AND net <> net_r)
UNION ALL
SELECT company_id, 'cost_of_revenue', y, round(CAST(disc AS DOUBLE), 4), 'concept rank 1 of 3; repeated in 1 later filing(s)' FROM ann
"""
)


def concept_coverage(spark, sf):
    return extract.coverage(disclosed(spark, sf, ["revenue"]))


CONCEPT_COVERAGE = sql(
    """
SELECT company_id, 'revenue' AS metric_id,
  CASE WHEN co % 4 = 0 AND y < 1998 THEN 'us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax' ELSE 'us-gaap:Revenues' END AS concept,
  count(*) * 4 AS periods_used, 0 AS periods_shadowed
FROM ann GROUP BY 1, 2, 3
"""
)


def concept_switch(spark, sf):
    found = extract.concept_switches(extract.coverage(disclosed(spark, sf, ["revenue"])))
    return found.select("company_id", "metric_id", "n_concepts", F.array_join("concepts", " ").alias("concepts"))


CONCEPT_SWITCH = sql(
    """
SELECT company_id, 'revenue' AS metric_id, 2 AS n_concepts, 'us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax us-gaap:Revenues' AS concepts
FROM ann WHERE co % 4 = 0 GROUP BY company_id HAVING min(y) < 1998 AND max(y) >= 1998
"""
)


def skip_reasons(spark, sf):
    return extract.skip_counts(mapped(spark, sf, ["revenue", "diluted_shares", "net_interest_income"]))


SKIP_REASONS = sql(
    """
SELECT company_id, 'form_not_accepted:8-K' AS reason, count(*) AS n FROM ann WHERE co % 8 = 0 GROUP BY 1
UNION ALL SELECT company_id, 'unit_incompatible:diluted_shares:USD', 2 * count(*) FROM ann WHERE co % 25 = 0 GROUP BY 1
UNION ALL SELECT company_id, 'unmapped_concept', 5 * count(*) FROM ann GROUP BY 1
"""
)


def observation_totals(spark, sf):
    return extract.observation_totals(mapped(spark, sf, ["revenue", "diluted_shares"]))


OBSERVATION_TOTALS = sql(
    """
SELECT company_id, CAST(sum(5 + 2 + CASE WHEN co % 8 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS observations_total,
  CAST(sum(5 + CASE WHEN co % 25 = 0 THEN 0 ELSE 2 END) AS BIGINT) AS observations_mapped FROM ann GROUP BY 1
"""
)


def currency_mismatches(spark, sf):
    return extract.currency_mismatches(extract.to_facts(disclosed(spark, sf, CORE)), tables.entities(spark, sf))


CURRENCY = sql(
    """
SELECT company_id, 'revenue' AS metric_id, 'EUR' AS currency, CAST(sum(4 + CASE WHEN co % 5 = 0 AND net <> net_r THEN 1 ELSE 0 END) AS BIGINT) AS n FROM ann WHERE co % 10 = 3 GROUP BY 1
UNION ALL SELECT company_id, 'cost_of_revenue', 'EUR', 4 * count(*) FROM ann WHERE co % 10 = 3 GROUP BY 1
"""
)


def missing_metrics(spark, sf):
    facts = extract.to_facts(disclosed(spark, sf, ["revenue", "diluted_shares"]))
    return extract.missing_metrics(tables.entities(spark, sf, "banks"), facts, frameworks("banks")).groupBy("company_id", "class").agg(F.count("*").alias("n"))


MISSING_METRICS = sql(
    """
SELECT 'co-' || s_suppkey AS company_id, c.class, c.n + CASE WHEN c.class = 'without_data' AND s_suppkey % 25 = 0 THEN 1 ELSE 0 END AS n
FROM supplier CROSS JOIN (VALUES ('without_data', 21), ('requires_documents', 4), ('derivation_only', 1)) c(class, n)
"""
)


def fiscal_period(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    end = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 400).cast("int"))
    start = F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate"))
    fye = (F.col("o_custkey") % 12 + 1).cast("int")
    convention = F.when(F.col("o_orderkey") % 2 == 0, "start_year").otherwise("end_year")
    return orders.select("o_orderkey", calendar.classify(start, end, fye, convention).alias("p")).select("o_orderkey", "p.*")


FISCAL_PERIOD = """
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS e,
    o_custkey % 12 + 1 AS fye, o_orderkey % 2 = 0 AS starts FROM orders),
m AS (SELECT *, CASE WHEN day(e) <= 7 THEN CASE WHEN month(e) = 1 THEN 12 ELSE month(e) - 1 END ELSE month(e) END AS em,
    CASE WHEN day(e) <= 7 AND month(e) = 1 THEN year(e) - 1 ELSE year(e) END AS ey, e - s + 1 AS days FROM d),
k AS (SELECT *, (em - fye + 12) % 12 AS off, CASE WHEN em = fye THEN 4 ELSE ((em - fye + 12) % 12) // 3 END AS qn,
    CASE WHEN em <= fye THEN ey ELSE ey + 1 END - CASE WHEN starts AND fye <> 12 THEN 1 ELSE 0 END AS fy FROM m),
r AS (SELECT *, CASE WHEN off % 3 <> 0 THEN 'period_end_not_fiscal_quarter_end' WHEN s IS NULL THEN NULL WHEN s >= e THEN 'invalid_period_dates'
    WHEN days BETWEEN 350 AND 380 THEN CASE WHEN qn <> 4 THEN 'annual_duration_not_ending_at_fiscal_year_end' END
    WHEN days BETWEEN 80 AND 100 THEN NULL
    WHEN days BETWEEN 170 AND 195 THEN CASE WHEN qn NOT IN (2, 4) THEN 'half_year_not_aligned_to_fiscal_halves' END
    WHEN days BETWEEN 260 AND 285 THEN CASE WHEN qn <> 3 THEN 'nine_month_not_ending_at_fiscal_q3' END
    ELSE 'unsupported_duration' END AS skip_reason FROM k)
SELECT o_orderkey, CASE WHEN skip_reason IS NULL THEN CAST(fy AS INTEGER) END AS fiscal_year,
  CASE WHEN skip_reason IS NOT NULL THEN NULL WHEN s IS NULL THEN CASE WHEN qn = 4 THEN 'FY' ELSE 'Q' || qn END WHEN days >= 350 THEN 'FY' WHEN days <= 100 THEN 'Q' || qn
    WHEN days <= 195 THEN CASE WHEN qn = 2 THEN 'H1' ELSE 'H2' END ELSE '9M' END AS fiscal_period, skip_reason FROM r
"""


# ---- derivation -------------------------------------------------------------------------------------------------


def interim_derived(spark, sf):
    events = derive.interim_events(current(spark, sf, ["revenue"]), frameworks())
    return derive.interim_facts(events).select("company_id", label(), dbl("value"), "formula", F.size("inputs").alias("n_inputs"), "period_start", "period_end")


_FYREV = "CASE WHEN co % 5 = 0 THEN net_r ELSE net END"
INTERIM = sql(
    f"""
SELECT company_id, c.code || '-' || y AS period, round(CAST(CASE c.code WHEN 'Q2' THEN q2 WHEN 'Q3' THEN q3 WHEN 'Q4' THEN fy - q1 - q2 - q3 ELSE fy - q1 - q2 END AS DOUBLE), 4) AS value,
  c.formula, 2 AS n_inputs, make_date(y, c.m0, 1) AS period_start, last_day(make_date(y, c.m1, 1)) AS period_end
FROM (SELECT a.co, a.y, a.company_id, {_FYREV} AS fy, coalesce((SELECT net FROM qs WHERE qs.co = a.co AND qs.y = a.y AND q = 1), 0) AS q1,
  coalesce((SELECT net FROM qs WHERE qs.co = a.co AND qs.y = a.y AND q = 2), 0) AS q2, coalesce((SELECT net FROM qs WHERE qs.co = a.co AND qs.y = a.y AND q = 3), 0) AS q3 FROM ann a)
CROSS JOIN (VALUES ('Q2', 'first_half - q1', 4, 6), ('Q3', 'nine_month_ytd - first_half', 7, 9), ('Q4', 'annual - nine_month_ytd', 10, 12), ('H2', 'annual - first_half', 7, 12)) c(code, formula, m0, m1)
"""
)


def formula_metrics(spark, sf):
    years = annual_current(spark, sf, ["revenue", "cost_of_revenue", "pre_tax_income", "income_tax_expense", "diluted_shares", "operating_cash_flow", "capital_expenditure"])
    events = derive.formula_events(years, frameworks())
    return derive.formula_facts(events).select("company_id", "metric_id", "fiscal_year", dbl("value_f", 4, "value"), "unit", F.size("inputs").alias("n_inputs"))


FORMULAS = sql(
    f"""
SELECT company_id, m.m AS metric_id, y AS fiscal_year, round(CASE m.m WHEN 'gross_profit' THEN CAST({_FYREV} - disc AS DOUBLE) WHEN 'net_income' THEN CAST(net - disc - tax AS DOUBLE)
   WHEN 'free_cash_flow' THEN CAST(net - tax AS DOUBLE) ELSE CAST(net - disc - tax AS DOUBLE) / CAST(qty AS DOUBLE) END, 4) AS value,
  cur || CASE WHEN m.m = 'diluted_eps' THEN '/share' ELSE '' END AS unit, 2 AS n_inputs
FROM (SELECT *, CASE WHEN co % 10 = 3 THEN 'EUR' ELSE 'USD' END AS cur FROM ann) CROSS JOIN (VALUES ('gross_profit'), ('net_income'), ('free_cash_flow'), ('diluted_eps')) m(m)
WHERE NOT (m.m = 'diluted_eps' AND (co % 25 = 0 OR qty = 0))
"""
)


def derivation_check(spark, sf):
    facts = current(spark, sf, ["revenue", "cost_of_revenue", "gross_profit"])
    events = derive.formula_events(facts, frameworks()).filter("metric_id = 'gross_profit'")
    return outcome_counts(derive.formula_outcomes(events))


DERIVATION_CHECK = sql(
    """
SELECT company_id, 'derivation:gross_profit' AS check_id, count(*) FILTER (diff = 0) AS passed, count(*) FILTER (diff <> 0) AS failed, 0 AS not_evaluable
FROM (SELECT company_id, CASE WHEN co % 6 = 0 THEN 1000 ELSE 0 END AS diff FROM ytd WHERE co % 3 = 0 AND i < 4
  UNION ALL SELECT company_id, net + CASE WHEN co % 6 = 0 THEN 1000 ELSE 0 END - CASE WHEN co % 5 = 0 THEN net_r ELSE net END FROM ann WHERE co % 3 = 0)
GROUP BY 1
"""
)


def derivation_counters(spark, sf):
    facts = stage(current(spark, sf, ["revenue", "cost_of_revenue", "diluted_shares"]), "current")
    interim = stage(derive.interim_events(facts, frameworks()), "interim")
    events = derive.formula_events(facts.unionByName(derive.interim_facts(interim)), frameworks(), traced=False)
    return derive.derivation_counts(facts, interim, events, frameworks()).groupBy("event").agg(F.sum("n").alias("n"))


DERIVATION_COUNTERS = sql(
    """
SELECT 'interim:' || c.c AS event, 2 * count(*) AS n FROM ann CROSS JOIN (VALUES ('Q2'), ('Q3'), ('Q4'), ('H2')) c(c) GROUP BY 1
UNION ALL SELECT 'interim_not_derivable_non_additive:diluted_shares', count(DISTINCT co) FROM ann WHERE co % 25 <> 0
UNION ALL SELECT 'framework:gross_profit', 8 * count(*) FROM ann
UNION ALL SELECT 'derivation_inputs_missing:diluted_eps', count(*) FROM ann WHERE co % 25 <> 0
"""
)


# ---- checks -----------------------------------------------------------------------------------------------------


def identity_checks(spark, sf):
    facts = current(spark, sf, ["total_assets", "total_liabilities", "total_equity"])
    events = checks.identity_events(facts, frameworks())
    return events.select("company_id", "check_id", "fiscal_year", "outcome", dbl("left", 4, "left_value"), dbl("right", 4, "right_value"), dbl("tolerance", 8))


_CUM = "cum AS (SELECT co, y, company_id, sum(gross) OVER w AS gross, sum(disc) OVER w AS disc, sum(net) OVER w AS net, sum(tax) OVER w AS tax FROM ann WINDOW w AS (PARTITION BY co ORDER BY y))"
# Rounding unit of a number: its last non-zero decimal place (four places at most here), capped at a million.
IDENTITY = sql(
    """
SELECT company_id, 'balance_sheet_identity' AS check_id, y AS fiscal_year, CASE WHEN co % 9 = 0 THEN 'failed' ELSE 'passed' END AS outcome,
  round(CAST(assets AS DOUBLE), 4) AS left_value, round(CAST(disc + net AS DOUBLE), 4) AS right_value, round(3 * least(pu(assets), pu(disc), pu(net)) / 2, 8) AS tolerance
FROM (SELECT *, gross + CASE WHEN co % 9 = 0 THEN 5000 ELSE 0 END AS assets FROM cum)
""".replace("pu(assets)", "{a}").replace("pu(disc)", "{d}").replace("pu(net)", "{n}").format(
        **{
            k: "pow(10.0, least(6, length(rtrim(s, '0')) * -1 + length(s) - 4))".replace("s,", f"{t},").replace("(s)", f"({t})")
            for k, t in (("a", "replace(CAST(CAST(assets AS DECIMAL(38,4)) AS VARCHAR), '.', '')"), ("d", "replace(CAST(CAST(disc AS DECIMAL(38,4)) AS VARCHAR), '.', '')"),
                         ("n", "replace(CAST(CAST(net AS DECIMAL(38,4)) AS VARCHAR), '.', '')"))
        }
    ),
    _CUM,
)


def cash_roll_forward(spark, sf):
    facts = stage(current(spark, sf, ["net_change_in_cash", "cash_and_restricted_cash"]), "current")
    facts = facts.unionByName(derive.interim_facts(derive.interim_events(facts, frameworks())))
    return outcome_counts(checks.identity_events(facts, frameworks(), ("cash_roll_forward",)))


CASH_ROLL = sql("SELECT company_id, 'cash_roll_forward' AS check_id, count(*) AS passed, 0 AS failed, 7 * count(*) AS not_evaluable FROM ann GROUP BY 1")


def cash_flow_sum(spark, sf):
    facts = current(spark, sf, ["operating_cash_flow", "investing_cash_flow", "financing_cash_flow", "net_change_in_cash"])
    return outcome_counts(checks.identity_events(facts, frameworks(), ("cash_flow_statement_sum",)))


CASH_SUM = sql("SELECT company_id, 'cash_flow_statement_sum' AS check_id, 4 * count(*) AS passed, 0 AS failed, 0 AS not_evaluable FROM ann GROUP BY 1")


def opening_balance(spark, sf):
    """Which dated balance opens each fiscal year, looked up one to eight days back."""
    facts = current(spark, sf, ["net_change_in_cash", "cash_and_restricted_cash"])
    frame = stage(derive.anchor_frame(facts, ["company_id", "framework", "period_type", "period_start", "period_end"]), "anchors")
    opened = checks.opening_balances(frame.filter("period_type = 'duration'"), frame.filter("period_type = 'instant'"), ["cash_and_restricted_cash"])
    cell = F.col("opening")["cash_and_restricted_cash" + specs.OPENING]
    return opened.select("company_id", "period_start", F.round(cell["value"].cast("double"), 4).alias("opening"))


OPENING_BALANCE = sql(
    "SELECT company_id, make_date(y, 1, 1) AS period_start, round(CAST(coalesce(lag(net - tax - disc) OVER (PARTITION BY co ORDER BY y), 0) AS DOUBLE), 4) AS opening FROM cum", _CUM
)


def sign_check(spark, sf):
    facts = stage(current(spark, sf, ["revenue"]), "current")
    facts = facts.unionByName(derive.interim_facts(derive.interim_events(facts, frameworks())))
    return outcome_counts(checks.sign_events(facts, frameworks()).withColumn("check_id", F.lit("sign")))


SIGN = sql(
    f"""
SELECT company_id, 'sign' AS check_id, 8 * count(*) - count(*) FILTER (fy < m9) - count(*) FILTER (fy < h1) AS passed,
  count(*) FILTER (fy < m9) + count(*) FILTER (fy < h1) AS failed, 0 AS not_evaluable
FROM (SELECT a.company_id, {_FYREV.replace('co', 'a.co').replace('net_r', 'a.net_r').replace('ELSE net', 'ELSE a.net')} AS fy,
   (SELECT net FROM ytd WHERE ytd.co = a.co AND ytd.y = a.y AND i = 3) AS m9, (SELECT net FROM ytd WHERE ytd.co = a.co AND ytd.y = a.y AND i = 2) AS h1 FROM ann a) GROUP BY 1
"""
)


def missing_years(spark, sf):
    found = checks.missing_years(annual_current(spark, sf, CORE, ("gap",)))
    return found.select("company_id", "metric_id", "first_year", "last_year", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"), "outcome")


MISSING_YEARS = sql(
    """
SELECT company_id, metric_id, min(y) AS first_year, max(y) AS last_year,
  coalesce((SELECT string_agg(CAST(g.g AS VARCHAR), ',' ORDER BY g.g) FROM range(1990, 2010) g(g) WHERE g.g > min(y) AND g.g < max(y) AND NOT list_contains(list(y), g.g)), '') AS missing,
  CASE WHEN max(y) - min(y) + 1 > count(*) THEN 'failed' ELSE 'passed' END AS outcome
FROM (SELECT company_id, y, 'revenue' AS metric_id FROM revgap UNION ALL SELECT company_id, y, 'cost_of_revenue' FROM ann) GROUP BY 1, 2 HAVING count(*) > 1
"""
)


def scale_break(spark, sf):
    found = checks.annual_changes(annual_current(spark, sf, ["revenue"], ("scale", "gap"))).filter("consecutive")
    return found.select("company_id", "fiscal_year", F.col("scale_outcome").alias("outcome"), dbl("log10_ratio", 6))


_PAIRS = """pairs AS (SELECT company_id, y, v, lag(v) OVER w AS pv, lag(y) OVER w AS py FROM revscale WHERE NOT (co % 6 = 0 AND y = 1998) WINDOW w AS (PARTITION BY company_id ORDER BY y))"""
SCALE = sql(
    """
SELECT company_id, y AS fiscal_year, CASE WHEN v * pv <= 0 THEN 'not_evaluable' WHEN abs(abs(lr) - 3) <= 0.2 OR abs(abs(lr) - 6) <= 0.2 OR abs(abs(lr) - 9) <= 0.2 THEN 'failed' ELSE 'passed' END AS outcome,
  round(lr, 6) AS log10_ratio
FROM (SELECT *, CASE WHEN v * pv > 0 THEN log10(v / pv) END AS lr FROM pairs WHERE py = y - 1)
""",
    _PAIRS,
)


def unusual_change(spark, sf):
    changes = checks.annual_changes(annual_current(spark, sf, ["revenue"], ("gap",)))
    found = checks.unusual_changes(changes)
    return found.select("company_id", "fiscal_year", "outcome", dbl("modified_z", 4))


UNUSUAL = sql(
    """
SELECT company_id, CASE WHEN ok THEN y END AS fiscal_year, CASE WHEN NOT ok THEN 'not_evaluable' WHEN abs(0.6745 * (g - med) / mad) > 3.5 THEN 'failed' ELSE 'passed' END AS outcome,
  CASE WHEN ok THEN round(0.6745 * (g - med) / mad, 4) END AS modified_z
FROM (SELECT m.*, median(abs(g - med)) OVER (PARTITION BY company_id) AS mad, n >= 5 AND median(abs(g - med)) OVER (PARTITION BY company_id) <> 0 AS ok,
   row_number() OVER (PARTITION BY company_id ORDER BY y) AS rn
  FROM (SELECT *, median(g) OVER (PARTITION BY company_id) AS med, count(g) OVER (PARTITION BY company_id) AS n
    FROM (SELECT company_id, y, CASE WHEN py = y - 1 AND v * pv > 0 THEN ln(v / pv) END AS g
      FROM (SELECT company_id, y, v, lag(v) OVER w AS pv, lag(y) OVER w AS py FROM revgap WINDOW w AS (PARTITION BY company_id ORDER BY y)))) m)
WHERE (ok AND g IS NOT NULL) OR (NOT ok AND rn = 1)
"""
)


def coverage_by_year(cells):
    """A column for every fiscal year that `cells` (company_id, metric_id, fiscal_year, cell) have."""
    cells = stage(cells, "cells")
    years = [r.fiscal_year for r in cells.select("fiscal_year").distinct().orderBy("fiscal_year").collect()]
    wide = cells.groupBy("company_id", "metric_id").pivot("fiscal_year", years).agg(F.max("cell"))
    return wide.select("company_id", "metric_id", *[F.col(f"`{y}`").alias(f"fy{y}") for y in years])


def coverage_matrix(spark, sf):
    cells = checks.coverage_cells(annual(spark, sf, ["revenue", "cost_of_revenue", "gross_profit"], ("gap",)))
    return coverage_by_year(cells.filter("metric_id IN ('revenue', 'gross_profit')"))


COVERAGE = sql(
    "SELECT company_id, 'revenue' AS metric_id, " + ", ".join(f"max(CASE WHEN y = {y} THEN 'R' END) AS fy{y}" for y in range(1995, 2002)) + " FROM revgap GROUP BY 1 UNION ALL "
    "SELECT a.company_id, 'gross_profit', " + ", ".join(f"max(CASE WHEN a.y = {y} THEN CASE WHEN a.co % 3 = 0 THEN 'R' WHEN r.y IS NOT NULL THEN 'D' END END)" for y in range(1995, 2002))
    + " FROM ann a LEFT JOIN revgap r USING (co, y) GROUP BY 1"
)


def check_rollup(spark, sf):
    facts = stage(current(spark, sf, ["revenue"], ("gap", "scale")), "current")
    changes = checks.annual_changes(facts)
    named = lambda df, check, column="outcome": df.select("company_id", F.lit(check).alias("check_id"), F.col(column).alias("outcome"))
    every = named(checks.missing_years(facts), "missing_years").unionByName(named(changes.filter("consecutive"), "scale_break", "scale_outcome"))
    return checks.check_rollup(every.unionByName(named(checks.sign_events(facts, frameworks()), "sign")))


CHECK_ROLLUP = sql(
    """
SELECT company_id, 'missing_years' AS check_id, CASE WHEN max(y) - min(y) + 1 = count(*) THEN 1 ELSE 0 END AS passed, CASE WHEN max(y) - min(y) + 1 > count(*) THEN 1 ELSE 0 END AS failed, 0 AS not_evaluable
FROM revgap GROUP BY 1
UNION ALL SELECT company_id, 'scale_break', count(*) FILTER (v * pv > 0 AND NOT bad), count(*) FILTER (v * pv > 0 AND bad), count(*) FILTER (v * pv <= 0)
FROM (SELECT *, CASE WHEN v * pv > 0 THEN abs(abs(log10(v / pv)) - 3) <= 0.2 OR abs(abs(log10(v / pv)) - 6) <= 0.2 OR abs(abs(log10(v / pv)) - 9) <= 0.2 END AS bad FROM pairs WHERE py = y - 1) GROUP BY 1
UNION ALL SELECT company_id, 'sign', 3 * count(*) + count(*) FILTER (NOT (co % 6 = 0 AND y = 1998)), 0, 0 FROM ann GROUP BY 1
""",
    _PAIRS,
)


def _all_issues(spark, sf):
    facts = stage(current(spark, sf, ["revenue", "total_assets", "total_liabilities", "total_equity"], ("gap", "scale")), "current")
    changes = checks.annual_changes(facts)
    return checks.identity_issues(checks.identity_events(facts, frameworks())).unionByName(
        checks.continuity_issues(checks.sign_events(facts, frameworks()), checks.missing_years(facts), changes, checks.unusual_changes(changes)))


def issue_counts(spark, sf):
    """What needs a look: without changes that are merely unusual, which `issue_counts_all` has."""
    return checks.severity_counts(_all_issues(spark, sf).filter("check_id <> 'unusual_change'"), tables.entities(spark, sf))


def issue_counts_all(spark, sf):
    return checks.severity_counts(_all_issues(spark, sf), tables.entities(spark, sf))


ISSUE_COUNTS = sql(
    """
SELECT 'co-' || s_suppkey AS company_id, 0 AS error, coalesce(b.n, 0) + coalesce(g.n, 0) + coalesce(s.n, 0) AS warning, 0 AS info FROM supplier
LEFT JOIN (SELECT company_id, count(*) AS n FROM ann WHERE co % 9 = 0 GROUP BY 1) b ON b.company_id = 'co-' || s_suppkey
LEFT JOIN (SELECT company_id, 1 AS n FROM revgap GROUP BY 1 HAVING max(y) - min(y) + 1 > count(*)) g ON g.company_id = 'co-' || s_suppkey
LEFT JOIN (SELECT company_id, count(*) AS n FROM pairs WHERE py = y - 1 AND v * pv > 0 AND (abs(abs(log10(v / pv)) - 3) <= 0.2 OR abs(abs(log10(v / pv)) - 6) <= 0.2 OR abs(abs(log10(v / pv)) - 9) <= 0.2) GROUP BY 1) s
  ON s.company_id = 'co-' || s_suppkey
""",
    _PAIRS,
)


ISSUE_COUNTS_ALL = sql(
    """
SELECT 'co-' || s_suppkey AS company_id, 0 AS error, coalesce(b.n, 0) + coalesce(g.n, 0) + coalesce(s.n, 0) AS warning, coalesce(u.n, 0) AS info FROM supplier
LEFT JOIN (SELECT company_id, count(*) AS n FROM ann WHERE co % 9 = 0 GROUP BY 1) b ON b.company_id = 'co-' || s_suppkey
LEFT JOIN (SELECT company_id, 1 AS n FROM revgap GROUP BY 1 HAVING max(y) - min(y) + 1 > count(*)) g ON g.company_id = 'co-' || s_suppkey
LEFT JOIN (SELECT company_id, count(*) AS n FROM pairs WHERE py = y - 1 AND v * pv > 0 AND (abs(abs(log10(v / pv)) - 3) <= 0.2 OR abs(abs(log10(v / pv)) - 6) <= 0.2 OR abs(abs(log10(v / pv)) - 9) <= 0.2) GROUP BY 1) s
  ON s.company_id = 'co-' || s_suppkey
LEFT JOIN (SELECT company_id, count(*) AS n FROM scored WHERE n >= 5 AND mad <> 0 AND abs(0.6745 * (g - med) / mad) > 3.5 GROUP BY 1) u ON u.company_id = 'co-' || s_suppkey
""",
    _PAIRS,
    _CUM,
    """series AS (SELECT company_id, 'revenue' AS m, y, CAST(v AS DOUBLE) AS v FROM revscale WHERE NOT (co % 6 = 0 AND y = 1998)
    UNION ALL SELECT company_id, 'assets', y, CAST(gross AS DOUBLE) + CASE WHEN co % 9 = 0 THEN 5000 ELSE 0 END FROM cum UNION ALL SELECT company_id, 'liabilities', y, CAST(disc AS DOUBLE) FROM cum
    UNION ALL SELECT company_id, 'equity', y, CAST(net AS DOUBLE) FROM cum)""",
    """logs AS (SELECT company_id, m, CASE WHEN py = y - 1 AND v * pv > 0 THEN ln(v / pv) END AS g FROM
    (SELECT *, lag(v) OVER w AS pv, lag(y) OVER w AS py FROM series WINDOW w AS (PARTITION BY company_id, m ORDER BY y)))""",
    "middle AS (SELECT *, median(g) OVER (PARTITION BY company_id, m) AS med, count(g) OVER (PARTITION BY company_id, m) AS n FROM logs)",
    "scored AS (SELECT *, median(abs(g - med)) OVER (PARTITION BY company_id, m) AS mad FROM middle)",
)


def short_history(spark, sf):
    return checks.short_histories(checks.coverage_cells(annual_current(spark, sf, CORE, ("gap",))), 7)


SHORT_HISTORY = sql(
    """
SELECT company_id, count(*) AS n_metrics, string_agg(metric_id, ', ' ORDER BY metric_id) AS metrics
FROM (SELECT company_id, 'revenue' AS metric_id FROM revgap GROUP BY 1 HAVING count(*) < 7 UNION ALL SELECT company_id, 'cost_of_revenue' FROM ann GROUP BY 1 HAVING count(*) < 7) GROUP BY 1
"""
)


def constraint_violations(spark, sf):
    """Facts with deliberate defects: every rule that a row breaks is reported."""
    facts = annual(spark, sf, ["revenue", "cost_of_revenue"])
    spoiled = facts.withColumn("currency", F.when((F.col("fiscal_year") == 1996) & F.col("currency").isNotNull(), "JPY").otherwise(F.col("currency"))).withColumn(
        "formula", F.when((F.col("provenance") == "derived") & (F.col("fiscal_year") == 1997), None).otherwise(F.col("formula"))
    ).withColumn("fiscal_year", F.when(F.col("fiscal_year") == 1998, 3998).otherwise(F.col("fiscal_year")))
    return constraints.fact_violations(spoiled).groupBy("rule").agg(F.count("*").alias("n"))


CONSTRAINTS = sql(
    """
SELECT 'unit_against_currency' AS rule, 3 * count(*) AS n FROM ann WHERE y = 1996
UNION ALL SELECT 'derived_without_inputs', count(*) FROM ann WHERE y = 1997
UNION ALL SELECT 'fiscal_year_out_of_range', 3 * count(*) FROM ann WHERE y = 1998
"""
)


# ---- analytics --------------------------------------------------------------------------------------------------


def _events(spark, sf, metrics, only, faults=(), formulas=False, fw=None, framework="generic", issues=None):
    fw = fw or frameworks(framework)
    facts = annual(spark, sf, metrics, faults, framework, fw, formulas)
    gated = facts.withColumn("blocked", F.lit(None).cast("string")).withColumn("flags", F.array().cast("array<string>")) if issues is None else analytics.gate(facts, issues)
    return analytics.analytic_events(analytics.annual_frame(gated), fw, only)


def _shown(events: DataFrame, places: int = 6) -> DataFrame:
    return events.select("company_id", "analytic_id", "fiscal_year", dbl("value", places), "reason", "basis", "currency")


def growth(spark, sf):
    return _shown(_events(spark, sf, ["revenue"], ["revenue_growth"], ("gap",)))


GROWTH = sql(
    """
SELECT company_id, 'revenue_growth' AS analytic_id, y AS fiscal_year, CASE WHEN reason IS NULL THEN round(v / pv - 1, 6) END AS value, reason, 'year_on_year' AS basis, CAST(NULL AS VARCHAR) AS currency
FROM (SELECT *, CASE WHEN py IS DISTINCT FROM y - 1 THEN CASE WHEN py IS NULL THEN 'start_of_history:revenue' ELSE 'prior_year_missing:revenue' END
   WHEN pv <= 0 THEN 'growth_base_not_positive:revenue' WHEN v <= 0 THEN 'growth_sign_change:revenue' END AS reason
  FROM (SELECT company_id, y, v, lag(v) OVER w AS pv, lag(y) OVER w AS py FROM revgap WINDOW w AS (PARTITION BY company_id ORDER BY y)))
"""
)


def growth_refusals(spark, sf):
    return _shown(_events(spark, sf, ["operating_income"], ["operating_income_growth"]))


_SWING = "sw AS (SELECT co, y, company_id, CAST(7 * net - sum(net) OVER (PARTITION BY co) AS DOUBLE) AS s FROM ann)"
GROWTH_REFUSALS = sql(
    """
SELECT company_id, 'operating_income_growth' AS analytic_id, y AS fiscal_year, CASE WHEN reason IS NULL THEN round(s / ps - 1, 6) END AS value, reason, 'year_on_year' AS basis, CAST(NULL AS VARCHAR) AS currency
FROM (SELECT *, CASE WHEN ps IS NULL THEN 'start_of_history:operating_income' WHEN ps <= 0 THEN 'growth_base_not_positive:operating_income' WHEN s <= 0 THEN 'growth_sign_change:operating_income' END AS reason
  FROM (SELECT *, lag(s) OVER (PARTITION BY co ORDER BY y) AS ps FROM sw))
""",
    _SWING,
)


def ratio_average_basis(spark, sf):
    return _shown(_events(spark, sf, ["revenue", "total_assets"], ["asset_turnover"]))


_ASSETS = "assets AS (SELECT co, y, company_id, CAST(gross + CASE WHEN co % 9 = 0 THEN 5000 ELSE 0 END AS DOUBLE) AS a FROM cum)"
RATIO_AVERAGE = sql(
    """
SELECT a.company_id, 'asset_turnover' AS analytic_id, a.y AS fiscal_year, CASE WHEN pa IS NOT NULL THEN round(v / ((a + pa) / 2), 6) END AS value,
  CASE WHEN pa IS NULL THEN 'start_of_history:total_assets' END AS reason, 'average' AS basis, CAST(NULL AS VARCHAR) AS currency
FROM (SELECT *, lag(a) OVER (PARTITION BY co ORDER BY y) AS pa FROM assets) a JOIN rev USING (co, y)
""",
    _CUM,
    _ASSETS,
)

_ON_OPENING = specs.Analytic("revenue_on_opening_assets", "Revenue / opening assets", "efficiency", "ratio", "multiple", numerator="revenue", denominator="total_assets", basis="opening")


def ratio_opening_basis(spark, sf):
    return _shown(_events(spark, sf, ["revenue", "total_assets"], ["revenue_on_opening_assets"], fw=extended("generic", (_ON_OPENING,))))


RATIO_OPENING = sql(
    """
SELECT a.company_id, 'revenue_on_opening_assets' AS analytic_id, a.y AS fiscal_year, round(v / pa, 6) AS value,
  CASE WHEN pa IS NULL THEN 'start_of_history:total_assets' END AS reason, 'opening' AS basis, CAST(NULL AS VARCHAR) AS currency
FROM (SELECT *, lag(a) OVER (PARTITION BY co ORDER BY y) AS pa FROM assets) a JOIN rev USING (co, y)
""",
    _CUM,
    _ASSETS,
)


def elasticity(spark, sf):
    return _shown(_events(spark, sf, ["revenue", "operating_income"], ["degree_of_operating_leverage"]), 4)


ELASTICITY = sql(
    """
SELECT company_id, 'degree_of_operating_leverage' AS analytic_id, y AS fiscal_year, CASE WHEN reason IS NULL THEN round((s / ps - 1) / (v / pv - 1), 4) END AS value, reason, 'year_on_year' AS basis, CAST(NULL AS VARCHAR) AS currency
FROM (SELECT *, CASE WHEN ps IS NULL THEN 'start_of_history:operating_income' WHEN ps <= 0 THEN 'growth_base_not_positive:operating_income' WHEN s <= 0 THEN 'growth_sign_change:operating_income'
   WHEN pv <= 0 THEN 'growth_base_not_positive:revenue' WHEN v <= 0 THEN 'growth_sign_change:revenue' WHEN v = pv THEN 'reference_growth_zero:revenue' END AS reason
  FROM (SELECT sw.*, rev.v, lag(s) OVER (PARTITION BY sw.co ORDER BY sw.y) AS ps, lag(v) OVER (PARTITION BY sw.co ORDER BY sw.y) AS pv FROM sw JOIN rev USING (co, y)))
""",
    _SWING,
)


def expression_chain(spark, sf):
    return _shown(_events(spark, sf, ["operating_income", "income_tax_expense", "pre_tax_income"], ["nopat"]), 2)


EXPRESSION = sql(
    """
SELECT company_id, 'effective_tax_rate' AS analytic_id, y AS fiscal_year, CASE WHEN p > 0 THEN round(t / p, 2) END AS value, CASE WHEN p <= 0 THEN 'denominator_not_positive' END AS reason, 'period_end' AS basis, CAST(NULL AS VARCHAR) AS currency FROM x
UNION ALL SELECT company_id, 'nopat', y, CASE WHEN p > 0 THEN round(s * (1 - t / p), 2) END, CASE WHEN p <= 0 THEN 'input_not_computed:effective_tax_rate' END, 'period_end', CASE WHEN co % 10 = 3 THEN 'EUR' ELSE 'USD' END FROM x
""",
    _SWING,
    "x AS (SELECT sw.*, CAST(net - disc AS DOUBLE) AS p, CAST(tax AS DOUBLE) AS t FROM sw JOIN ann USING (co, y))",
)

_STRICT = specs.Check("balance_sheet_identity", "total_assets", "total_liabilities + total_equity", (), "error")


def quality_gate(spark, sf):
    """Balances that do not tie are blocked; warnings about gross profit travel on as flags."""
    fw = extended("generic", (), (_STRICT,))
    metrics = ["revenue", "cost_of_revenue", "gross_profit", "total_assets", "total_liabilities", "total_equity"]
    facts = stage(annual_current(spark, sf, metrics), "annual")
    formulas = derive.formula_events(facts, fw)
    issues = stage(checks.identity_issues(checks.identity_events(facts, fw)).unionByName(derive.formula_issues(formulas)), "issues")
    events = analytics.run_analytics(facts.unionByName(derive.formula_facts(formulas)), issues, fw, ["liabilities_to_equity", "gross_margin"])
    return events.select("company_id", "analytic_id", "fiscal_year", dbl("value", 6), "reason", F.array_join("quality_flags", ",").alias("flags"), "uses_derived")


QUALITY_GATE = sql(
    """
SELECT company_id, 'liabilities_to_equity' AS analytic_id, y AS fiscal_year, CASE WHEN co % 9 <> 0 THEN round(CAST(disc AS DOUBLE) / CAST(net AS DOUBLE), 6) END AS value,
  CASE WHEN co % 9 = 0 THEN 'input_failed_quality:balance_sheet_identity' END AS reason, '' AS flags, false AS uses_derived FROM cum
UNION ALL
SELECT a.company_id, 'gross_margin', a.y, CASE WHEN v > 0 THEN round((CASE WHEN a.co % 3 = 0 THEN CAST(a.net - a.disc AS DOUBLE) + adj ELSE v - CAST(a.disc AS DOUBLE) END) / v, 6) END,
  CASE WHEN v <= 0 THEN 'denominator_not_positive' END,
  CASE WHEN a.co % 3 = 0 AND CAST(a.net AS DOUBLE) + adj <> v THEN 'derivation:gross_profit' ELSE '' END, a.co % 3 <> 0
FROM (SELECT *, CASE WHEN co % 6 = 0 THEN 1000 ELSE 0 END AS adj FROM ann) a JOIN rev USING (co, y)
""",
    _CUM,
)


def not_computed(spark, sf):
    events = _events(spark, sf, ["revenue", "total_assets", "operating_income"], ["revenue_growth", "asset_turnover", "operating_income_growth", "net_margin"], ("gap",))
    return analytics.not_computed(events).groupBy("analytic_id", "reason").agg(F.sum("n").alias("n"))


NOT_COMPUTED = sql(
    """
SELECT analytic_id, reason, count(*) AS n FROM (
 SELECT 'revenue_growth' AS analytic_id, CASE WHEN py IS NULL THEN 'start_of_history:revenue' WHEN py <> y - 1 THEN 'prior_year_missing:revenue' WHEN pv <= 0 THEN 'growth_base_not_positive:revenue' WHEN v <= 0 THEN 'growth_sign_change:revenue' END AS reason
  FROM (SELECT company_id, y, v, lag(v) OVER w AS pv, lag(y) OVER w AS py FROM revgap WINDOW w AS (PARTITION BY company_id ORDER BY y))
 UNION ALL SELECT 'asset_turnover', CASE WHEN r.y IS NULL THEN 'input_missing:revenue' WHEN a.y = y0 THEN 'start_of_history:total_assets' END
  FROM (SELECT *, min(y) OVER (PARTITION BY co) AS y0 FROM ann) a LEFT JOIN revgap r USING (co, y)
 UNION ALL SELECT 'operating_income_growth', CASE WHEN ps IS NULL THEN 'start_of_history:operating_income' WHEN ps <= 0 THEN 'growth_base_not_positive:operating_income' WHEN s <= 0 THEN 'growth_sign_change:operating_income' END
  FROM (SELECT *, lag(s) OVER (PARTITION BY co ORDER BY y) AS ps FROM sw)
 UNION ALL SELECT 'net_margin', 'input_missing:net_income' FROM revgap)
WHERE reason IS NOT NULL GROUP BY 1, 2
""",
    _SWING,
)


def gap_rollup(spark, sf):
    events = _events(spark, sf, ["revenue", "operating_income"], ["revenue_growth", "operating_income_growth"], ("gap",))
    counts = analytics.not_computed(events).select("company_id", F.lit("generic").alias("framework"), F.col("analytic_id").alias("item"), "reason", "n")
    told = display.explain(counts, display.name_table(spark, frameworks()), into="sentence")
    return summary.gap_rollup(told)


GAP_ROLLUP = sql(
    """
SELECT company_id, item, CAST(any_value(total) AS BIGINT) AS total, arg_min(reason, place) AS main_reason, string_agg(reason, ' ' ORDER BY place) AS reasons
FROM (SELECT *, row_number() OVER (PARTITION BY company_id, item ORDER BY n DESC, reason) AS place
  FROM (SELECT *, sum(n) OVER (PARTITION BY company_id, item) AS total, max(CASE WHEN reason NOT LIKE 'start_of_history%' THEN 1 ELSE 0 END) OVER (PARTITION BY company_id, item) AS rooted
    FROM (SELECT company_id, item, arg_max(reason, (n, -ascii(substr(reason, 8)))) AS reason, sum(n) AS n FROM (SELECT company_id, item, reason, count(*) AS n FROM (
      SELECT company_id, 'revenue_growth' AS item, CASE WHEN py IS NULL THEN 'start_of_history:revenue' WHEN py <> y - 1 THEN 'prior_year_missing:revenue' WHEN pv <= 0 THEN 'growth_base_not_positive:revenue' WHEN v <= 0 THEN 'growth_sign_change:revenue' END AS reason
        FROM (SELECT company_id, y, v, lag(v) OVER w AS pv, lag(y) OVER w AS py FROM revgap WINDOW w AS (PARTITION BY company_id ORDER BY y))
      UNION ALL SELECT company_id, 'operating_income_growth', CASE WHEN ps IS NULL THEN 'start_of_history:operating_income' WHEN ps <= 0 THEN 'growth_base_not_positive:operating_income' WHEN s <= 0 THEN 'growth_sign_change:operating_income' END
        FROM (SELECT *, lag(s) OVER (PARTITION BY co ORDER BY y) AS ps FROM sw)) WHERE reason IS NOT NULL GROUP BY 1, 2, 3)
      GROUP BY company_id, item, CASE WHEN reason LIKE 'growth%' THEN 'growth cannot be told' ELSE reason END))
  WHERE rooted = 0 OR reason NOT LIKE 'start_of_history%')
WHERE place <= 2 GROUP BY 1, 2
""",
    _SWING,
)


# ---- statistics -------------------------------------------------------------------------------------------------


def series_summary(spark, sf):
    events = _events(spark, sf, ["revenue", "total_debt", "cash_and_equivalents"], ["revenue_growth", "net_debt"], ("gap",))
    s = summary.series_summary(analytics.analytic_values(events), frameworks())
    money = ["latest", "median", "mean", "stdev", "min_value", "max_value", "avg_3y", "avg_5y", "trend_per_year", "cagr_full", "cagr_3y", "cagr_5y"]
    return s.select("company_id", "analytic_id", "observations", "first_year", "latest_year", "min_year", "max_year", "down_years", *[dbl(m, 4) for m in money])


SERIES_SUMMARY = sql(
    """
SELECT company_id, analytic_id, count(*) AS observations, min(y) AS first_year, max(y) AS latest_year, arg_min(y, x) AS min_year, arg_max(y, x) AS max_year,
  CASE WHEN analytic_id = 'revenue_growth' THEN count(*) FILTER (x < 0) END AS down_years,
  round(arg_max(x, y), 4) AS latest, round(median(x), 4) AS median, round(avg(x), 4) AS mean, CASE WHEN count(*) >= 3 THEN round(stddev_samp(x), 4) END AS stdev,
  round(min(x), 4) AS min_value, round(max(x), 4) AS max_value,
  CASE WHEN count(*) FILTER (y > ly - 3) = 3 THEN round(avg(x) FILTER (y > ly - 3), 4) END AS avg_3y, CASE WHEN count(*) FILTER (y > ly - 5) = 5 THEN round(avg(x) FILTER (y > ly - 5), 4) END AS avg_5y,
  CASE WHEN count(*) >= 5 THEN round(regr_slope(x, y), 4) END AS trend_per_year,
  round(CASE WHEN analytic_id = 'net_debt' AND max(y) > min(y) AND arg_min(x, y) > 0 AND arg_max(x, y) > 0 THEN pow(arg_max(x, y) / arg_min(x, y), 1.0 / (max(y) - min(y))) - 1 END, 4) AS cagr_full,
  round(CASE WHEN analytic_id = 'net_debt' AND max(x) FILTER (y = ly - 3) > 0 AND arg_max(x, y) > 0 THEN pow(arg_max(x, y) / max(x) FILTER (y = ly - 3), 1.0 / 3) - 1 END, 4) AS cagr_3y,
  round(CASE WHEN analytic_id = 'net_debt' AND max(x) FILTER (y = ly - 5) > 0 AND arg_max(x, y) > 0 THEN pow(arg_max(x, y) / max(x) FILTER (y = ly - 5), 1.0 / 5) - 1 END, 4) AS cagr_5y
FROM (SELECT *, max(y) OVER (PARTITION BY company_id, analytic_id) AS ly FROM (
  SELECT company_id, 'revenue_growth' AS analytic_id, y, v / pv - 1 AS x FROM (SELECT company_id, y, v, lag(v) OVER w AS pv, lag(y) OVER w AS py FROM revgap WINDOW w AS (PARTITION BY company_id ORDER BY y)) WHERE py = y - 1 AND pv > 0 AND v > 0
  UNION ALL SELECT company_id, 'net_debt', y, CAST(disc AS DOUBLE) - CAST(tax AS DOUBLE) FROM cum))
GROUP BY 1, 2
""",
    _CUM,
)


def max_drawdown(spark, sf):
    found = summary.growth_drawdowns(annual_current(spark, sf, ["revenue"]), frameworks())
    return found.select("company_id", "analytic_id", dbl("decline", 6), "peak_year", "trough_year")


MAX_DRAWDOWN = sql(
    """
SELECT company_id, 'revenue_growth' AS analytic_id, round(decline, 6) AS decline, peak_year, trough_year FROM (
  SELECT t.company_id, t.y AS trough_year, p.y AS peak_year, t.v / p.v - 1 AS decline, row_number() OVER (PARTITION BY t.co ORDER BY t.v / p.v - 1, t.y) AS rn
  FROM rev t JOIN rev p ON p.co = t.co AND p.y < t.y AND t.v <= p.v AND p.v = (SELECT max(v) FROM rev r WHERE r.co = t.co AND r.y <= t.y)
  WHERE (SELECT min(v) FROM rev r WHERE r.co = t.co) > 0) WHERE rn = 1
"""
)


def year_islands(spark, sf):
    return summary.year_islands(summary.metric_series(annual_current(spark, sf, CORE, ("gap",))))


YEAR_ISLANDS = sql(
    """
SELECT company_id, series_id, min(y) AS from_year, max(y) AS to_year, count(*) AS points FROM (
  SELECT *, y - row_number() OVER (PARTITION BY company_id, series_id ORDER BY y) AS g FROM (SELECT company_id, 'revenue' AS series_id, y FROM revgap UNION ALL SELECT company_id, 'cost_of_revenue', y FROM ann))
GROUP BY company_id, series_id, g
"""
)


def year_ranges_text(spark, sf):
    series = summary.metric_series(annual_current(spark, sf, ["revenue"], ("gap",)))
    return series.groupBy("company_id").agg(F.collect_set("fiscal_year").alias("years")).select("company_id", summary.years_text(F.col("years")).alias("years"))


YEAR_RANGES = sql(
    """
SELECT company_id, string_agg(CASE WHEN a = b THEN 'FY' || a ELSE 'FY' || a || '–FY' || b END, ' and ' ORDER BY a) AS years FROM (
  SELECT company_id, min(y) AS a, max(y) AS b FROM (SELECT company_id, y, y - row_number() OVER (PARTITION BY company_id ORDER BY y) AS g FROM revgap) GROUP BY company_id, g) GROUP BY 1
"""
)


def series_truncation(spark, sf):
    facts = annual_current(spark, sf, CORE, ("gap",))
    series = summary.metric_series(facts).filter("series_id <> 'revenue' OR company_id NOT LIKE '%4' OR fiscal_year < 2000")
    span = summary.metric_series(facts).groupBy("company_id").agg(F.max("fiscal_year").alias("last_year"))
    found = summary.series_coverage(series, span)
    return found.select("company_id", "series_id", "first_year", "series_end", "points", F.array_join(F.col("holes").cast("array<string>"), ",").alias("holes"), "truncated_after")


SERIES_TRUNCATION = sql(
    """
SELECT s.company_id, series_id, min(y) AS first_year, max(y) AS series_end, count(*) AS points,
  CASE WHEN series_id = 'revenue' AND s.co % 6 = 0 AND min(y) < 1998 AND max(y) > 1998 THEN '1998' ELSE '' END AS holes, CASE WHEN max(y) < any_value(last_year) THEN max(y) END AS truncated_after
FROM (SELECT co, company_id, y, 'revenue' AS series_id FROM revgap WHERE co % 10 <> 4 OR y < 2000 UNION ALL SELECT co, company_id, y, 'cost_of_revenue' FROM ann) s
JOIN (SELECT company_id, max(y) AS last_year FROM ann GROUP BY 1) l USING (company_id) GROUP BY 1, 2, s.co
"""
)


def presentation_unit(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    value = F.round(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 4 == 0, 1000).when(F.col("o_orderkey") % 4 == 1, 0.01).otherwise(1), 0).cast("decimal(28,8)")
    return orders.select("o_orderkey", numeric.presentation_unit(value).cast("double").alias("unit"), numeric.rounding_tolerance(F.array(value, value * 10)).cast("double").alias("tolerance"))


_PU = "CASE WHEN v = 0 THEN NULL ELSE pow(10, least(6, length(CAST(v AS VARCHAR)) - length(rtrim(CAST(v AS VARCHAR), '0')))) END"
PRESENTATION_UNIT = f"""
SELECT o_orderkey, CAST({_PU} AS DOUBLE) AS unit, CAST(coalesce({_PU}, 0) AS DOUBLE) AS tolerance
FROM (SELECT o_orderkey, CAST(round(o_totalprice * CASE WHEN o_orderkey % 4 = 0 THEN 1000 WHEN o_orderkey % 4 = 1 THEN 0.01 ELSE 1 END, 0) AS BIGINT) AS v FROM orders)
"""

QUERIES = {
    "facts_current": (facts_current, FACTS_CURRENT),
    "restatements": (restatements, RESTATEMENTS),
    "repeated_disclosures": (repeated_disclosures, REPEATED),
    "concept_coverage": (concept_coverage, CONCEPT_COVERAGE),
    "concept_switch": (concept_switch, CONCEPT_SWITCH),
    "skip_reasons": (skip_reasons, SKIP_REASONS),
    "observation_totals": (observation_totals, OBSERVATION_TOTALS),
    "currency_mismatches": (currency_mismatches, CURRENCY),
    "missing_metrics": (missing_metrics, MISSING_METRICS),
    "fiscal_period": (fiscal_period, FISCAL_PERIOD),
    "interim_derived": (interim_derived, INTERIM),
    "formula_metrics": (formula_metrics, FORMULAS),
    "derivation_check": (derivation_check, DERIVATION_CHECK),
    "derivation_counters": (derivation_counters, DERIVATION_COUNTERS),
    "identity_checks": (identity_checks, IDENTITY),
    "cash_roll_forward": (cash_roll_forward, CASH_ROLL),
    "cash_flow_sum": (cash_flow_sum, CASH_SUM),
    "opening_balance": (opening_balance, OPENING_BALANCE),
    "sign_check": (sign_check, SIGN),
    "missing_years": (missing_years, MISSING_YEARS),
    "scale_break": (scale_break, SCALE),
    "unusual_change": (unusual_change, UNUSUAL),
    "coverage_matrix": (coverage_matrix, COVERAGE),
    "check_rollup": (check_rollup, CHECK_ROLLUP),
    "issue_counts": (issue_counts, ISSUE_COUNTS),
    "issue_counts_all": (issue_counts_all, ISSUE_COUNTS_ALL),
    "short_history": (short_history, SHORT_HISTORY),
    "constraint_violations": (constraint_violations, CONSTRAINTS),
    "growth": (growth, GROWTH),
    "growth_refusals": (growth_refusals, GROWTH_REFUSALS),
    "ratio_average_basis": (ratio_average_basis, RATIO_AVERAGE),
    "ratio_opening_basis": (ratio_opening_basis, RATIO_OPENING),
    "elasticity": (elasticity, ELASTICITY),
    "expression_chain": (expression_chain, EXPRESSION),
    "quality_gate": (quality_gate, QUALITY_GATE),
    "not_computed": (not_computed, NOT_COMPUTED),
    "gap_rollup": (gap_rollup, GAP_ROLLUP),
    "series_summary": (series_summary, SERIES_SUMMARY),
    "max_drawdown": (max_drawdown, MAX_DRAWDOWN),
    "year_islands": (year_islands, YEAR_ISLANDS),
    "year_ranges_text": (year_ranges_text, YEAR_RANGES),
    "series_truncation": (series_truncation, SERIES_TRUNCATION),
    "presentation_unit": (presentation_unit, PRESENTATION_UNIT),
}
