"""Outputs read back, configuration, ids, constraints, company views and their texts, over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, ids, text
from ..operators import analytics, checks, constraints, entities, lineage, registry, summary
from ..plans import views
from ..schemas import ANALYTICS, FACTS
from ..session import shared_folder, stage
from ..sources import config, filings, sinks, specs, tables
from .common import annual_current, dbl, extended, frameworks, sql
from .facts_set import _events, _shown


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- outputs read back ------------------------------------------------------------------------------------------


def facts_json_round_trip(spark, sf):
    path = _folder(spark, "facts-json")
    sinks.write_facts_json(sinks.fixed(annual_current(spark, sf, ["revenue"]), FACTS), path)
    return filings.read_facts(spark, path).select("company_id", "metric_id", "fiscal_year", dbl("value"), "provenance", F.size("inputs").alias("n_inputs"))


FACTS_JSON = sql("SELECT company_id, 'revenue' AS metric_id, CAST(y AS INTEGER) AS fiscal_year, round(v, 4) AS value, 'reported' AS provenance, 0 AS n_inputs FROM rev")


def analytics_round_trip(spark, sf):
    path = _folder(spark, "analytics")
    values = analytics.analytic_values(_events(spark, sf, ["revenue"], ["revenue_growth"]))
    known = [c.split()[0] for c in ANALYTICS.replace("array<string>", "a").split(", ")]
    sinks.write_parquet(sinks.fixed(values.select(*known), ANALYTICS), path)
    return sinks.read_analytics(spark, path).select("company_id", "analytic_id", "fiscal_year", dbl("value", 6))


ANALYTICS_TRIP = sql(
    "SELECT company_id, 'revenue_growth' AS analytic_id, CAST(y AS INTEGER) AS fiscal_year, round(v / pv - 1, 6) AS value FROM "
    "(SELECT company_id, y, v, lag(v) OVER w AS pv, lag(y) OVER w AS py FROM rev WINDOW w AS (PARTITION BY co ORDER BY y)) WHERE py = y - 1 AND pv > 0 AND v > 0"
)


def long_csv_round_trip(spark, sf):
    path = _folder(spark, "csv")
    sinks.write_csv(sinks.long_view(annual_current(spark, sf, ["revenue"])), path)
    return spark.read.option("header", "true").csv(path).select("company_id", "metric_id", "period", "value", "unit")


LONG_CSV = sql(
    "SELECT company_id, 'revenue' AS metric_id, 'FY' || y AS period, regexp_replace(CAST(CAST(CASE WHEN co % 5 = 0 THEN net_r ELSE net END AS DECIMAL(28,8)) AS VARCHAR), '\\.?0+$', '') AS value, "
    "CASE WHEN co % 10 = 3 THEN 'EUR' ELSE 'USD' END AS unit FROM ann"
)


# ---- configuration ----------------------------------------------------------------------------------------------


def _configured(spark, sf) -> DataFrame:
    """A configuration per customer: some without an id, some with blank sources, some with addresses on file."""
    c = _read(spark, sf, "customer")
    k = F.col("c_custkey")
    some = F.struct(F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit("https://example.com/"), k.cast("string"))).alias("url"), F.when(k % 5 == 0, F.concat(F.lit("file-"), k.cast("string"))).alias("path"), F.lit(None).cast("string").alias("fiscal_period"))
    company = F.struct(
        F.col("c_name").alias("name"), F.concat(F.lit("t"), k.cast("string")).alias("ticker"), F.lit("NYSE").alias("exchange"), F.lit("US").alias("country"), F.lit("x").alias("sector"), F.lit(None).cast("string").alias("industry_framework"),
        F.struct(F.when(k % 4 == 0, "none").otherwise(k.cast("string")).alias("cik"), F.lit("").alias("lei"), F.lit("").alias("isin")).alias("identifiers"), F.lit("USD").alias("reporting_currency"), (k % 12 + 1).cast("int").alias("fiscal_year_end_month"),
        F.lit(None).cast("string").alias("fiscal_year_convention"), F.when(k % 2 == 0, F.concat(F.lit("own-"), k.cast("string"))).alias("company_id"))
    return c.select(company.alias("company"), F.create_map(F.lit("annual_reports"), F.array(some)).alias("sources"), F.struct(F.lit(None).cast("int").alias("historical_years"), F.lit(3).alias("forecast_years")).alias("research"))


def company_config(spark, sf):
    return config.companies(_configured(spark, sf)).select("company_id", "ticker", "cik", "fye_month", "convention", "historical_years", "forecast_years")


COMPANY_CONFIG = """
SELECT CASE WHEN k % 2 = 0 THEN 'own-' || k ELSE 'nyse-t' || k END AS company_id, 'T' || k AS ticker, CASE WHEN k % 4 <> 0 THEN lpad(CAST(k AS VARCHAR), 10, '0') END AS cik, CAST(k % 12 + 1 AS INTEGER) AS fye_month,
  'end_year' AS convention, 10 AS historical_years, 3 AS forecast_years FROM (SELECT c_custkey AS k FROM customer)
"""


def config_sources(spark, sf):
    return config.sources_of(_configured(spark, sf)).select("company_id", "kind", "url", "path")


CONFIG_SOURCES = """
SELECT CASE WHEN k % 2 = 0 THEN 'own-' || k ELSE 'nyse-t' || k END AS company_id, 'annual_reports' AS kind, CASE WHEN k % 3 <> 0 THEN 'https://example.com/' || k END AS url, CASE WHEN k % 5 = 0 THEN 'file-' || k END AS path
FROM (SELECT c_custkey AS k FROM customer) WHERE k % 3 <> 0 OR k % 5 = 0
"""


def config_violations(spark, sf):
    c = _read(spark, sf, "customer")
    k = F.col("c_custkey")
    who = c.select(k.cast("string").alias("company_id"), F.when(k % 7 == 0, F.lit(None)).otherwise(F.lpad(k.cast("string"), 10, "0")).alias("cik"), F.lit("T").alias("ticker"), F.lit(12).alias("fye_month"))
    address = F.when(k % 5 == 0, F.concat(F.lit("http://plain.example/"), k.cast("string"))).otherwise(F.concat(F.lit("https://example.com/"), k.cast("string")))
    listed = c.select(k.cast("string").alias("company_id"), F.when(k % 6 == 0, "investor_relations").otherwise("annual_reports").alias("kind"), address.alias("url"), F.when(k % 11 == 0, "also").alias("path"))
    again = listed.filter(k % 9 == 0)
    return entities.config_violations(who, listed.unionByName(again)).groupBy("company_id", "rule").agg(F.count("*").alias("n"))


CONFIG_VIOLATIONS = """
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN 2 ELSE 1 END AS times FROM customer)
SELECT CAST(k AS VARCHAR) AS company_id, 'source_listed_twice' AS rule, 1 AS n FROM c WHERE times = 2
UNION ALL SELECT CAST(k AS VARCHAR), 'two_locations', times FROM c WHERE k % 11 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'not_https', times FROM c WHERE k % 5 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'no_primary_source', 1 FROM c WHERE k % 6 = 0
"""


def _authored(spark, sf) -> DataFrame:
    """A file per order with one entry, some of which cannot be used."""
    k = F.col("o_orderkey")
    entry = F.concat(
        F.lit('[{"company_id":"'), F.when(k % 10 == 0, "other").otherwise(F.col("o_custkey").cast("string")), F.lit('","key":"growth.'), k.cast("string"), F.lit('","type":"'),
        F.when(k % 6 == 0, "historical").when(k % 6 == 1, "scenario").otherwise("analyst_assumption"), F.lit('","scenario":"'), F.when(k % 4 == 0, "high").otherwise("low"), F.lit('","'), F.when(k % 7 == 0, "vlaue").otherwise("rationale"), F.lit('":"r","value":'),
        F.when(k % 13 == 0, '"many"').otherwise("0.05"), F.lit("}]"))
    return _read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("file_company_id"), entry.alias("json"))


def authored_assumptions(spark, sf):
    read, refused = config.authored_assumptions(_authored(spark, sf))
    declared = read.select("company_id", F.lit("low").alias("scenario")).distinct()
    rejected = config.assumption_rejections(read, declared)
    return refused.unionByName(rejected).select("rule", "key")


AUTHORED = """
WITH a AS (SELECT 'growth.' || o_orderkey AS key, o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown_field:vlaue' WHEN o_orderkey % 13 = 0 THEN 'no_number' END AS broken FROM orders)
SELECT broken AS rule, key FROM a WHERE broken IS NOT NULL
UNION ALL SELECT 'other_company', key FROM a WHERE broken IS NULL AND k % 10 = 0
UNION ALL SELECT 'engine_computed_type', key FROM a WHERE broken IS NULL AND k % 6 = 0
UNION ALL SELECT 'undeclared_scenario', key FROM a WHERE broken IS NULL AND k % 6 = 1 AND k % 4 = 0
"""


def library_entries(spark, sf):
    o = _read(spark, sf, "orders")
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("o_custkey").cast("string"), F.lit("/0000000001200000"), F.lpad((k % 50).cast("string"), 2, "0"), F.lit("/a.htm"))
    entries = o.select(F.col("o_custkey").cast("string").alias("company_id"), k.alias("entry_id"), F.when(k % 3 == 0, F.concat(F.lit("h"), (k % 4).cast("string"))).alias("sha256"), url.alias("url"), F.col("o_orderdate").alias("added_at"))
    return config.library(entries.withColumn("entry_id", F.lpad(F.col("entry_id").cast("string"), 12, "0"))).select("company_id", "entry_id", "accession")


LIBRARY = """
SELECT CAST(o_custkey AS VARCHAR) AS company_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS entry_id, '0000000001-20-0000' || lpad(CAST(o_orderkey % 50 AS VARCHAR), 2, '0') AS accession FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'h' || o_orderkey % 4 ELSE 'u' || o_orderkey % 50 END ORDER BY o_orderdate, lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) = 1
"""


# ---- ids, texts, registry ---------------------------------------------------------------------------------------


def record_ids(spark, sf):
    o = _read(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.concat(F.lit("co-"), F.col("o_custkey").cast("string"))
    inputs = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("z"), k.cast("string")), F.lit("a")))
    day = F.to_date("o_orderdate")
    return o.select(
        k.alias("o_orderkey"), ids.fact_id(c, F.lit("m"), F.lit("duration"), F.when(k % 2 == 0, day), day, F.lit("FY2020"), "reported", F.col("o_orderstatus")).alias("fact_id"),
        ids.document_id(c, "annual", F.col("o_orderstatus")).alias("document_id"), ids.analytic_id(c, F.lit("growth"), F.year(day), inputs).alias("analytic_id"), ids.forecast_id(c, F.lit("base"), F.lit("m"), F.year(day), inputs).alias("forecast_id"))


RECORD_IDS = """
WITH o AS (SELECT o_orderkey, o_orderkey AS k, 'co-' || o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '|a|z' || o_orderkey END AS i FROM orders)
SELECT o_orderkey, 'fact_' || substr(sha256(c || '|m|duration|' || CASE WHEN k % 2 = 0 THEN CAST(d AS VARCHAR) ELSE '' END || '|' || d || '|FY2020|reported|' || coalesce(o_orderstatus, '')), 1, 16) AS fact_id,
  'doc_' || substr(sha256(c || '|annual|' || coalesce(o_orderstatus, '')), 1, 16) AS document_id, 'ana_' || substr(sha256(c || '|growth|' || year(d) || i), 1, 16) AS analytic_id,
  'fcv_' || substr(sha256(c || '|base|m|' || year(d) || i), 1, 16) AS forecast_id FROM o
"""


def text_rules(spark, sf):
    p = _read(spark, sf, "pages")
    return p.select("page_id", text.media_type(F.col("html")).alias("media"), text.slugify(F.col("url")).alias("slug"), text.cik10(F.col("page_id")).alias("cik"), text.ticker_ok(F.upper(F.substring_index("url", ".", -1))).alias("ticker_ok"))


TEXT_RULES = """
SELECT page_id, CASE WHEN lower(left(ltrim(html), 4096)) LIKE '%<html%' OR lower(ltrim(html)) LIKE '<!doctype html%' THEN 'html' END AS media, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  lpad(CAST(page_id AS VARCHAR), 10, '0') AS cik, regexp_matches(upper(split_part(url, '.', -1)), '^[A-Z0-9][A-Z0-9.\\-]{0,11}$') AS ticker_ok FROM pages
"""


def registry_lookup(spark, sf):
    o = _read(spark, sf, "orders")
    k = F.col("o_orderkey")
    docs = o.select(k.alias("document_id"), F.col("o_custkey").alias("company_id"), F.when(k % 5 == 0, "superseded").when(k % 5 == 1, "failed").otherwise("parsed").alias("status"), F.when(k % 2 == 0, "annual").otherwise("interim").alias("type"), F.lit("h").alias("hash"))
    found = registry.registered(docs, kind="annual").withColumn("asked", F.lit("annual"))
    return found.unionByName(registry.registered(docs, status="superseded").withColumn("asked", F.lit("superseded"))).select("asked", "document_id", "status")


REGISTRY_LOOKUP = """
WITH d AS (SELECT o_orderkey AS document_id, CASE o_orderkey % 5 WHEN 0 THEN 'superseded' WHEN 1 THEN 'failed' ELSE 'parsed' END AS status FROM orders)
SELECT 'annual' AS asked, * FROM d WHERE document_id % 2 = 0 AND status <> 'superseded' UNION ALL SELECT 'superseded', * FROM d WHERE status = 'superseded'
"""


def gap_keys(spark, sf):
    """Keys joined and taken apart again, and the sentence for an assumption that could not be measured."""
    o = _read(spark, sf, "orders")
    code = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("input_missing:"), F.col("o_orderkey").cast("string"))).otherwise("start_of_history")
    keyed = o.select("o_orderkey", F.lit("generic").alias("framework"), display.gap_key(F.col("o_custkey").cast("string"), code).alias("gap"), F.when(F.col("o_orderkey") % 3 == 0, "growth.total_debt").otherwise("level.no_such_metric").alias("key"))
    told = display.unseeded_text(keyed.select("*", display.split_gap_key(F.col("gap")).alias("s")), display.name_table(spark, frameworks()))
    return told.select("o_orderkey", F.col("s.item").alias("item"), F.col("s.code").alias("code"), "text")


GAP_KEYS = """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS item, CASE WHEN o_orderkey % 2 = 0 THEN 'input_missing:' || o_orderkey ELSE 'start_of_history' END AS code,
  'Not enough recent history to measure a trend for ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Total debt' ELSE 'No such metric' END || '.' AS text FROM orders
"""


# ---- constraints ------------------------------------------------------------------------------------------------


def record_violations(spark, sf):
    o = _read(spark, sf, "orders")
    k = F.col("o_orderkey")
    none, one = F.array().cast("array<string>"), F.array(F.lit("fact_0123456789abcdef"))
    key = k.cast("string")
    values = o.select(key.alias("value_id"), F.when(k % 3 == 0, none).when(k % 7 == 0, F.array(F.lit("fact_x"))).otherwise(one).alias("input_fact_ids"), none.alias("input_value_ids"), F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(1.0).alias("value"))
    assumed = o.select(
        F.concat(F.when(k % 4 == 0, "Bad ").otherwise("growth."), key).alias("key"), F.when(k % 3 == 0, "consensus").when(k % 3 == 1, "scenario").otherwise("analyst_assumption").alias("type"), F.when(k % 2 == 0, "doc").alias("source_document_id"),
        none.alias("source_fact_ids"), F.when(k % 5 != 0, "why").alias("rationale"), F.when(k % 3 != 0, "low").alias("scenario"), F.when(k % 7 == 0, "2020").otherwise("FY2020").alias("period"))
    projected = o.select(key.alias("value_id"), F.when(k % 2 == 0, "actual").otherwise("growth").alias("method"), F.when(k % 3 == 0, F.array(F.lit("a"))).otherwise(none).alias("assumption_ids"), none.alias("assumption_types"), none.alias("input_fact_ids"), none.alias("input_value_ids"), F.lit(1.0).alias("value"))
    documents_ = o.select(key.alias("document_id"), F.when(k % 2 == 0, "registered").otherwise("parsed").alias("status"), F.when(k % 3 == 0, "h").alias("hash"))
    parts = [constraints.analytic_violations(values), constraints.assumption_violations(assumed), constraints.forecast_violations(projected), constraints.document_violations(documents_)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("rule").agg(F.count("*").alias("n"))


RECORD_VIOLATIONS = """
WITH o AS (SELECT o_orderkey AS k FROM orders), r AS (
  SELECT 'no_inputs' AS rule FROM o WHERE k % 3 = 0 UNION ALL SELECT 'bad_fact_id' FROM o WHERE k % 3 <> 0 AND k % 7 = 0 UNION ALL SELECT 'value_not_finite' FROM o WHERE k % 5 = 0
  UNION ALL SELECT 'outlook_without_document' FROM o WHERE k % 3 = 0 AND k % 2 <> 0 UNION ALL SELECT 'analyst_without_rationale' FROM o WHERE k % 3 = 2 AND k % 5 = 0
  UNION ALL SELECT 'scenario_incomplete' FROM o WHERE k % 3 = 1 AND k % 5 = 0 UNION ALL SELECT 'scenario_on_other_type' FROM o WHERE k % 3 = 2
  UNION ALL SELECT 'bad_period' FROM o WHERE k % 7 = 0 UNION ALL SELECT 'bad_key' FROM o WHERE k % 4 = 0
  UNION ALL SELECT 'assumption_types_differ' FROM o WHERE k % 3 = 0 UNION ALL SELECT 'actual_without_fact' FROM o WHERE k % 2 = 0 UNION ALL SELECT 'actual_with_assumption' FROM o WHERE k % 2 = 0 AND k % 3 = 0
  UNION ALL SELECT 'exogenous_without_assumption' FROM o WHERE k % 2 <> 0 AND k % 3 <> 0
  UNION ALL SELECT 'content_without_hash' FROM o WHERE k % 2 <> 0 AND k % 3 <> 0 UNION ALL SELECT 'hash_without_content' FROM o WHERE k % 2 = 0 AND k % 3 = 0)
SELECT rule, count(*) AS n FROM r GROUP BY rule
"""


def _order_facts(spark, sf) -> DataFrame:
    """A fact per order: reported ones cite a document per customer, derived ones the order before; some of both are unknown."""
    k = F.col("o_orderkey")
    return _read(spark, sf, "orders").select(
        F.concat(F.lit("f"), k.cast("string")).alias("fact_id"), F.col("o_custkey").alias("company_id"), F.lit("m").alias("metric_id"), F.lit("instant").alias("period_type"), F.lit(None).cast("date").alias("period_start"), F.to_date("o_orderdate").alias("period_end"),
        F.when(k % 2 == 0, "reported").otherwise("derived").alias("provenance"), F.when(k % 2 == 0, F.concat(F.lit("d"), F.col("o_custkey").cast("string"))).alias("document_id"),
        F.when(k % 2 != 0, F.array(F.concat(F.lit("f"), F.when(k % 9 == 0, -k).otherwise(k).cast("string")))).otherwise(F.array().cast("array<string>")).alias("inputs"))


def integrity_violations(spark, sf):
    known = _read(spark, sf, "customer").filter("c_custkey % 10 <> 0").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("document_id"))
    return lineage.integrity_violations(_order_facts(spark, sf), known)


INTEGRITY = """
SELECT 'unknown_document' AS rule, 'f' || o_orderkey AS fact_id, 'd' || o_custkey AS missing FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
UNION ALL SELECT 'unknown_input', 'f' || o_orderkey, 'f' || -o_orderkey FROM orders WHERE o_orderkey % 2 <> 0 AND o_orderkey % 9 = 0 AND -o_orderkey NOT IN (SELECT o_orderkey FROM orders)
"""


def duplicate_current(spark, sf):
    return constraints.duplicate_current(_order_facts(spark, sf)).select("company_id", "period_end", "n", "first_fact_id")


DUPLICATES = "SELECT o_custkey AS company_id, CAST(o_orderdate AS DATE) AS period_end, count(*) AS n, min('f' || o_orderkey) AS first_fact_id FROM orders GROUP BY 1, 2 HAVING count(*) > 1"


def unmatched_metrics(spark, sf):
    facts = annual_current(spark, sf, ["revenue", "total_assets"])
    return checks.metrics_without_data(tables.entities(spark, sf), facts, frameworks()).groupBy("company_id", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("metric_id").isin("revenue", "total_assets")).alias("had_data"))


UNMATCHED = sql(f"SELECT DISTINCT company_id, 'no_xbrl_data' AS reason, {sum(bool(m.concepts) for m in specs.shipped()['generic'].metrics.values()) - 2} AS n, 0 AS had_data FROM ann")


# ---- views ------------------------------------------------------------------------------------------------------


def company_list(spark, sf):
    """Companies with the stages they have, in the order of the pipeline, whatever order they were recorded in."""
    o = _read(spark, sf, "orders")
    done = o.select(F.col("o_custkey").alias("company_id"), F.element_at(F.array(*[F.lit(s) for s in views.STAGES]), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("stage"))
    return views.company_list(_read(spark, sf, "customer").select(F.col("c_custkey").alias("company_id")), done).select("company_id", F.array_join("stages", ",").alias("stages"))


COMPANY_LIST = """
SELECT c_custkey AS company_id, coalesce((SELECT string_agg(s, ',' ORDER BY i) FROM (SELECT DISTINCT o_orderkey % 4 AS i, ['ingest', 'quality', 'analyze', 'forecast'][o_orderkey % 4 + 1] AS s FROM orders WHERE o_custkey = c_custkey)), '') AS stages FROM customer
"""


def library_view(spark, sf):
    c = _read(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    k = F.col("doc_id")
    judged = c.filter(k % 3 != 0).select("doc_id", F.when(k % 3 == 1, "verified").otherwise("rejected").alias("status"), F.when(k % 2 == 0, 2).otherwise(0).alias("contributed"), F.lit("as judged").alias("reason"))
    return views.library_view(c, judged).select("doc_id", "reason", (F.col("status_label") == "Checked — nothing new").alias("nothing_new"))


LIBRARY_VIEW = "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'It will be read on the next analysis run.' ELSE 'as judged' END AS reason, c_custkey % 3 = 1 AND c_custkey % 2 <> 0 AS nothing_new FROM customer"


def assumptions_view(spark, sf):
    o = _read(spark, sf, "orders")
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, "median over FY2019-FY2021").when(k % 3 == 1, "measured over FY2020").otherwise("as told")
    assumed = o.select(F.col("o_custkey").alias("company_id"), k.alias("n"), F.when(k % 2 == 0, "growth.total_debt").otherwise("rate.unheard_of").alias("key"), F.when(k % 3 == 2, "analyst_assumption").otherwise("historical").alias("type"), said.alias("description"), F.lit(None).cast("string").alias("rationale"))
    who = _read(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), F.lit("generic").alias("framework"))
    return views.assumptions_view(assumed, who, display.name_table(spark, frameworks())).select("n", "label", "basis_text")


ASSUMPTIONS_VIEW = """
SELECT o_orderkey AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'Total debt growth' ELSE 'rate.unheard_of' END AS label,
  CASE o_orderkey % 3 WHEN 0 THEN 'Median, FY2019–FY2021' WHEN 1 THEN 'FY2020 only' ELSE 'as told' END AS basis_text FROM orders JOIN customer ON c_custkey = o_custkey
"""


def drawn_charts(spark, sf):
    """Which charts are drawn: a currency chart needs one currency, every chart two points."""
    o = _read(spark, sf, "orders")
    points = o.select(F.col("o_custkey").alias("company_id"), F.lit("generic").alias("framework"), F.concat(F.lit("s"), (F.col("o_orderkey") % 2).cast("string")).alias("series_id"), F.when(F.col("o_orderkey") % 16 == 1, "EUR").otherwise("USD").alias("currency"))
    charts = points.select("framework", "series_id").distinct().withColumn("chart_id", F.lit("c")).withColumn("format", F.lit("currency"))
    return summary.chart_status(points, charts).select("company_id", "chart_id", "series_drawn", "skipped")


DRAWN_CHARTS = """
WITH p AS (SELECT o_custkey AS company_id, o_orderkey % 2 AS s, CASE WHEN o_orderkey % 16 = 1 THEN 'EUR' ELSE 'USD' END AS cur FROM orders), s AS (SELECT company_id, s, count(*) AS n, min(cur) AS lo, max(cur) AS hi FROM p GROUP BY 1, 2)
SELECT company_id, 'c' AS chart_id, count(*) AS series_drawn, CASE WHEN max(n) < 2 THEN 'fewer_than_two_points' WHEN min(lo) <> max(hi) THEN 'currency_not_uniform' END AS skipped FROM s GROUP BY 1
"""


def analytics_lines(spark, sf):
    """Series as a reader gets them: points, statistics and why years are missing."""
    events = _events(spark, sf, ["revenue"], ["revenue_growth"], ("gap",))
    values = stage(analytics.analytic_values(events), "values")
    refused = analytics.not_computed(events).select("company_id", F.lit("generic").alias("framework"), F.col("analytic_id").alias("item"), "reason", "n")
    gaps = summary.gap_rollup(display.explain(refused, display.name_table(spark, frameworks()), into="sentence"))
    seen = views.analytics_view(values, summary.series_summary(values, frameworks()).select("company_id", "analytic_id", "observations"), gaps, frameworks())
    return seen.select("company_id", "name", "category", F.size("points").alias("n_points"), F.element_at("points", -1)["fiscal_year"].alias("last_year"), "observations", "gap_count")


ANALYTICS_LINES = sql(
    """
SELECT company_id, 'Revenue growth' AS name, 'growth' AS category, CAST(count(x) AS INTEGER) AS n_points, CAST(max(y) FILTER (x IS NOT NULL) AS INTEGER) AS last_year, count(x) AS observations, count(*) - count(x) AS gap_count
FROM (SELECT company_id, y, CASE WHEN py = y - 1 AND pv > 0 AND v > 0 THEN v / pv - 1 END AS x FROM (SELECT company_id, y, v, lag(v) OVER w AS pv, lag(y) OVER w AS py FROM revgap WINDOW w AS (PARTITION BY company_id ORDER BY y))) GROUP BY 1
"""
)


_LEVEL = specs.Analytic("revenue_level", "Revenue", "size", "level", "currency", metric="revenue")


def level_analytic(spark, sf):
    return _shown(_events(spark, sf, ["revenue"], ["revenue_level"], fw=extended("generic", (_LEVEL,))), 4).select("company_id", "analytic_id", "fiscal_year", "value", "reason")


LEVEL = sql("SELECT company_id, 'revenue_level' AS analytic_id, CAST(y AS INTEGER) AS fiscal_year, round(v, 4) AS value, CAST(NULL AS VARCHAR) AS reason FROM rev")


def fiscal_years(spark, sf):
    facts = annual_current(spark, sf, ["revenue"], ("gap",))
    return analytics.fiscal_years(facts).select("company_id", F.array_join(F.transform("fiscal_years", lambda y: y.cast("string")), ",").alias("years"))


FISCAL_YEARS = sql("SELECT company_id, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS years FROM revgap GROUP BY 1")


def severity_order(spark, sf):
    o = _read(spark, sf, "orders")
    severity = F.when(F.col("o_orderkey") % 4 == 0, "info").when(F.col("o_orderkey") % 4 == 1, "warning").when(F.col("o_orderkey") % 4 == 2, "error").otherwise("unheard_of")
    return o.select("o_orderkey", severity.alias("s")).select("o_orderkey", "s", checks.severity_rank(F.col("s")).alias("place"))


SEVERITY = """
SELECT o_orderkey, s, coalesce(list_position(['error', 'warning', 'info'], s), 0) AS place FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'unheard_of' END AS s FROM orders)
"""

QUERIES = {
    "facts_json_round_trip": (facts_json_round_trip, FACTS_JSON),
    "analytics_round_trip": (analytics_round_trip, ANALYTICS_TRIP),
    "long_csv_round_trip": (long_csv_round_trip, LONG_CSV),
    "company_config": (company_config, COMPANY_CONFIG),
    "config_sources": (config_sources, CONFIG_SOURCES),
    "config_violations": (config_violations, CONFIG_VIOLATIONS),
    "authored_assumptions": (authored_assumptions, AUTHORED),
    "library_entries": (library_entries, LIBRARY),
    "record_ids": (record_ids, RECORD_IDS),
    "text_rules": (text_rules, TEXT_RULES),
    "registry_lookup": (registry_lookup, REGISTRY_LOOKUP),
    "gap_keys": (gap_keys, GAP_KEYS),
    "record_violations": (record_violations, RECORD_VIOLATIONS),
    "integrity_violations": (integrity_violations, INTEGRITY),
    "duplicate_current": (duplicate_current, DUPLICATES),
    "unmatched_metrics": (unmatched_metrics, UNMATCHED),
    "company_list": (company_list, COMPANY_LIST),
    "library_view": (library_view, LIBRARY_VIEW),
    "assumptions_view": (assumptions_view, ASSUMPTIONS_VIEW),
    "drawn_charts": (drawn_charts, DRAWN_CHARTS),
    "analytics_lines": (analytics_lines, ANALYTICS_LINES),
    "level_analytic": (level_analytic, LEVEL),
    "fiscal_years": (fiscal_years, FISCAL_YEARS),
    "severity_order": (severity_order, SEVERITY),
}
