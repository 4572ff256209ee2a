"""Company configuration, authored assumptions and the document library as tables, with their rejections as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import accession_from_url, slugify

COMPANY = (
    "company struct<name:string,ticker:string,exchange:string,country:string,sector:string,industry_framework:string,"
    "identifiers:struct<cik:string,lei:string,isin:string>,reporting_currency:string,fiscal_year_end_month:int,"
    "fiscal_year_convention:string,company_id:string>, sources map<string,array<struct<url:string,path:string,fiscal_period:string>>>, "
    "research struct<historical_years:int,forecast_years:int>"
)
# Fields of an authored assumption; any other is refused, as a misspelt one would be lost in silence.
AUTHORED = ("company_id", "key", "type", "value", "unit", "period", "scenario", "description", "rationale", "source_document_id", "effective_date")
DECLARABLE = ("management_guidance", "consensus", "analyst_assumption", "scenario")


def companies(raw: DataFrame) -> DataFrame:
    """One row per configured company (raw in the COMPANY schema)."""
    c = F.col("company")
    digits = F.trim(c["identifiers"]["cik"])
    return raw.select(
        F.coalesce(c["company_id"], slugify(F.concat_ws("-", c["exchange"], c["ticker"]))).alias("company_id"), c["name"].alias("name"),
        F.upper(F.trim(c["ticker"])).alias("ticker"), c["exchange"].alias("exchange"), c["country"].alias("country"), c["industry_framework"].alias("override"),
        F.when(digits.rlike(r"^\d{1,10}$"), F.lpad(digits, 10, "0")).alias("cik"), c["reporting_currency"].alias("reporting_currency"),
        c["fiscal_year_end_month"].alias("fye_month"), F.coalesce(c["fiscal_year_convention"], F.lit("end_year")).alias("convention"),
        F.coalesce("research.historical_years", F.lit(10)).alias("historical_years"), F.coalesce("research.forecast_years", F.lit(5)).alias("forecast_years"),
    )


def sources_of(raw: DataFrame) -> DataFrame:
    """(company_id, kind, url, path, fiscal_period); blank placeholders are dropped."""
    c = F.col("company")
    who = F.coalesce(c["company_id"], slugify(F.concat_ws("-", c["exchange"], c["ticker"])))
    blank = lambda name: F.nullif(F.trim(F.coalesce(F.col(name), F.lit(""))), F.lit(""))
    rows = raw.select(who.alias("company_id"), F.explode("sources").alias("kind", "refs")).select("company_id", "kind", F.explode("refs").alias("r"))
    return rows.select("company_id", "kind", blank("r.url").alias("url"), blank("r.path").alias("path"), "r.fiscal_period").filter("url IS NOT NULL OR path IS NOT NULL")


def authored_assumptions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Authored files (file_company_id, json: a list of objects) as rows, and (company_id, rule, key) for entries that
    cannot be read: an unknown field, no key, or a value that is no number. Those are in the second table only."""
    entry = raw.select("file_company_id", F.explode_outer(F.from_json("json", "array<map<string,string>>")).alias("m"))
    unknown = F.array_sort(F.array_except(F.map_keys("m"), F.array(*[F.lit(a) for a in AUTHORED])))
    number = F.col("m")["value"].try_cast("double")
    why = F.when(F.col("m").isNull(), "unreadable").when(F.size(unknown) > 0, F.concat(F.lit("unknown_field:"), F.array_join(unknown, ",")))
    why = why.when(F.col("m")["key"].isNull(), "no_key").when(number.isNull(), "no_number")
    fields = [number.alias("value") if a == "value" else F.col("m")[a].alias(a) for a in AUTHORED if a != "company_id"]
    rows = entry.select("file_company_id", F.coalesce(F.col("m")["company_id"], "file_company_id").alias("company_id"), *fields, why.alias("rule"))
    return rows.filter("rule IS NULL").drop("rule"), rows.filter("rule IS NOT NULL").select("company_id", "rule", "key")


def assumption_rejections(authored: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(company_id, rule, key) for authored assumptions that may not be used. authored: ASSUMPTIONS plus file_company_id."""
    report = lambda df, rule: df.select("company_id", F.lit(rule).alias("rule"), "key")
    other = authored.filter("company_id <> file_company_id")
    claimed = authored.filter(~F.col("type").isin(*DECLARABLE))
    declared = scenarios.select("company_id", "scenario").unionByName(authored.select("company_id", F.lit("base").alias("scenario"))).distinct()
    undeclared = authored.filter("type = 'scenario'").join(declared, ["company_id", "scenario"], "left_anti")
    same = ["company_id", "key", "period", "scenario", "type"]
    twice = authored.groupBy(*same).agg(F.count("*").alias("n")).filter("n > 1")
    return report(other, "other_company").unionByName(report(claimed, "engine_computed_type")).unionByName(
        report(undeclared, "undeclared_scenario")).unionByName(report(twice, "duplicate"))


def library(entries: DataFrame) -> DataFrame:
    """Library entries deduplicated by content, or by address where there is no content; the earliest entry stays."""
    identity = F.coalesce("sha256", "url", "entry_id")
    kept = entries.withColumn("identity", identity).groupBy("company_id", "identity").agg(
        F.min_by(F.struct(*[c for c in entries.columns if c != "company_id"]), F.struct("added_at", "entry_id")).alias("e"))
    return kept.select("company_id", "e.*").withColumn("accession", accession_from_url(F.col("url")))
