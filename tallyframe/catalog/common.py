"""What the queries share: short paths to facts, and the SQL that states the same base tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import period_label
from ..operators import checks, derive, extract
from ..session import stage
from ..sources import specs, tables


def frameworks(*names: str) -> dict[str, specs.Framework]:
    shipped = specs.shipped()
    return {n: shipped[n] for n in (names or ("generic",))}


def extended(name: str, analytics: tuple[specs.Analytic, ...] = (), checks_: tuple[specs.Check, ...] = ()) -> dict[str, specs.Framework]:
    """A shipped framework with a user's own analytics and checks added."""
    base = frameworks(name)[name]
    return {name: replace(base, analytics=base.analytics | {a.id: a for a in analytics}, checks=base.checks | {c.id: c for c in checks_})}


def mapped(spark: SparkSession, sf: str, metrics: list[str], faults: tuple[str, ...] = (), fw=None, framework: str = "generic", full_years: bool = False, compacted: bool = True) -> DataFrame:
    fw = fw or frameworks(framework)
    return extract.map_observations(tables.observations(spark, sf, metrics, faults, full_years), tables.entities(spark, sf, framework), fw, compacted)


def disclosed(spark, sf, metrics, faults=(), framework="generic") -> DataFrame:
    return extract.disclosures(mapped(spark, sf, metrics, faults, framework=framework))


def current(spark, sf, metrics, faults=(), framework="generic") -> DataFrame:
    return extract.current_facts(extract.to_facts(disclosed(spark, sf, metrics, faults, framework)))


def annual_current(spark, sf, metrics, faults=(), framework="generic") -> DataFrame:
    return annual(spark, sf, metrics, faults, framework, formulas=False)


def annual(spark, sf, metrics, faults=(), framework="generic", fw=None, formulas: bool = True) -> DataFrame:
    """Current full-year facts and the formula metrics over them (of `fw`, where a reader needs only some). Year-to-date
    rows of other quarters are not made, so the filter drops little and reads what was stored. A row of these tables is
    filed once, so there is nothing to compact before it is mapped."""
    years = extract.current_of(mapped(spark, sf, metrics, faults, framework=framework, full_years=True, compacted=False))
    if not formulas:
        return years.filter("fiscal_period = 'FY'")
    years = stage(years, "annual").filter("fiscal_period = 'FY'")
    return years.unionByName(derive.formula_facts(derive.formula_events(years, fw or frameworks(framework))))


def no_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "company_id string, check_id string, severity string, metric_id string, period string, fact_ids array<string>, details map<string,string>")


def label() -> Column:
    return period_label(F.col("fiscal_year"), F.col("fiscal_period")).alias("period")


def dbl(name: str, places: int = 4, alias: str | None = None) -> Column:
    return F.round(F.col(name).cast("double"), places).alias(alias or name.split(".")[-1])


def outcome_counts(df: DataFrame, column: str = "outcome") -> DataFrame:
    return checks.check_rollup(df.select("company_id", "check_id", F.col(column).alias("outcome")))


# ---- the same base in SQL ---------------------------------------------------------------------------------------

BASE = """
li AS (SELECT l_suppkey AS co, CAST(year(l_shipdate) AS INTEGER) AS y, CAST(quarter(l_shipdate) AS INTEGER) AS q,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS px, CAST(l_discount AS DECIMAL(4,2)) AS dc, CAST(l_tax AS DECIMAL(4,2)) AS tx,
  CAST(l_quantity AS DECIMAL(18,2)) AS qt, l_returnflag AS rf FROM lineitem),
qs AS (SELECT co, y, q, sum(px) AS gross, sum(px*dc) AS disc, sum(px*(1-dc)) AS net, sum(px*(1-dc)*tx) AS tax, sum(qt) AS qty,
  sum(CASE WHEN rf <> 'R' THEN px*(1-dc) ELSE 0 END) AS net_r FROM li GROUP BY 1,2,3),
ann AS (SELECT co, y, 'co-' || co AS company_id, sum(gross) AS gross, sum(disc) AS disc, sum(net) AS net, sum(tax) AS tax, sum(qty) AS qty,
  sum(net_r) AS net_r FROM qs GROUP BY 1,2),
ytd AS (SELECT a.co, a.y, a.company_id, i.i, sum(CASE WHEN qs.q <= i.i THEN qs.net ELSE 0 END) AS net,
  sum(CASE WHEN qs.q <= i.i THEN qs.disc ELSE 0 END) AS disc, sum(CASE WHEN qs.q <= i.i THEN qs.tax ELSE 0 END) AS tax
  FROM ann a CROSS JOIN (VALUES (1),(2),(3),(4)) i(i) JOIN qs ON qs.co = a.co AND qs.y = a.y GROUP BY 1,2,3,4),
rev AS (SELECT co, y, company_id, CAST(CASE WHEN co % 5 = 0 THEN net_r ELSE net END AS DOUBLE) AS v FROM ann),
revgap AS (SELECT * FROM rev WHERE NOT (co % 6 = 0 AND y = 1998)),
revscale AS (SELECT r.co, r.y, r.company_id, CASE WHEN r.co % 11 = 0 AND r.y = 1999 THEN CAST(a.net AS DOUBLE) * 1000 ELSE r.v END AS v
  FROM rev r JOIN ann a USING (co, y))
"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()
