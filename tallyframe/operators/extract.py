"""Observations to canonical facts.

Shape of the plan: one compaction that collapses repeats map-side (company, tag, dates, value, filing), a broadcast
join to the tag table, one aggregation per distinct disclosed value, and one window per (company, metric, period).
A company or tag that holds a large share of the rows is spread by the compaction key before anything is grouped
by company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, ids
from ..schemas import FACT_COLUMNS, MONEY
from ..sources.specdata import ACCEPTED_FORMS
from ..sources.specs import Framework, concept_targets, metric_spec

PERIOD_KEY = ["company_id", "metric_id", "period_type", "period_start", "period_end"]


# ---- units ------------------------------------------------------------------------------------------------------


def normalize_unit(unit: Column) -> Column:
    return F.replace(unit, F.lit("-per-"), F.lit("/"))


def unit_accepted(unit_kind: Column, unit: Column) -> Column:
    currency, per_share = unit.rlike("^[A-Z]{3}$"), unit.rlike("^[A-Z]{3}/shares$")
    return (
        F.when(unit_kind == "currency", currency)
        .when(unit_kind == "currency_per_share", per_share)
        .when(unit_kind == "ratio", unit == "pure")
        .otherwise((unit != "pure") & ~currency & ~unit.contains("/"))
    )


def canonical_unit(unit: Column) -> Column:
    return F.regexp_replace(unit, "^([A-Z]{3})/shares$", "$1/share")


def currency_of(unit: Column) -> Column:
    return F.when(unit.rlike("^[A-Z]{3}(/shares)?$"), F.substring(unit, 1, 3))


# ---- mapping ----------------------------------------------------------------------------------------------------


def compact(observations: DataFrame) -> DataFrame:
    """One row per (tag, unit, dates, value, filing) with the number of raw rows behind it."""
    keys = ["company_id", "taxonomy", "concept", "unit", "value", "period_start", "period_end", "form", "accession", "frame"]
    return observations.groupBy(*keys).agg(F.min("filed").alias("filed"), F.count("*").alias("n"))


def map_observations(observations: DataFrame, entities: DataFrame, frameworks: dict[str, Framework], compacted: bool = True) -> DataFrame:
    """One row per (observation, metric it could feed), with the reason when it is refused.

    `lead` marks one row per observation: a refusal that concerns the observation itself counts there only, while a
    refusal by a metric counts for every metric. `n` is the number of raw observations behind a row. Not compacted: every
    raw observation is a row, for sources that hardly repeat any and readers that group the rows themselves.
    """
    who = entities.select("company_id", "framework", "fye_month", "convention", "reporting_currency")
    dated = (
        (compact(observations) if compacted else observations.withColumn("n", F.lit(1)))
        .join(who, "company_id")
        .withColumn("qname", F.concat_ws(":", "taxonomy", "concept"))
        .withColumn("period_type", F.when(F.col("period_start").isNull(), "instant").otherwise("duration"))
        .transform(calendar.with_period)
        .join(concept_targets(observations.sparkSession, frameworks), ["framework", "qname"], "left")
    )
    refused = (
        F.when(F.col("targets").isNull(), "unmapped_concept")
        .when(~F.col("form").isin(*ACCEPTED_FORMS), F.concat(F.lit("form_not_accepted:"), "form"))
        .otherwise(F.col("period.skip_reason"))
    )

    def metric_refusal(target: Column) -> Column:
        name = target["metric_id"]
        return F.when(target["metric_period_type"] != F.col("period_type"), F.concat(F.lit("period_type_mismatch:"), name)).when(
            ~unit_accepted(target["unit_kind"], F.col("unit")), F.concat_ws(":", F.lit("unit_incompatible"), name, "unit")
        )

    # Any metric that takes the observation; read only by the totals, pruned from every other plan.
    taken = F.exists("targets", lambda t: metric_refusal(t).isNull())
    return (
        dated.withColumn("refused", refused)
        .select("*", F.posexplode_outer(F.when(F.col("refused").isNull(), F.col("targets"))).alias("at", "target"))
        .select(
            "company_id", "framework", "reporting_currency", "qname", "unit", "value", "period_type", "period_start", "period_end",
            "period.fiscal_year", "period.fiscal_period", "accession", "form", "filed", "frame", "n",
            "target.metric_id", "target.rank", "target.ranks",
            F.coalesce("refused", metric_refusal(F.col("target"))).alias("reason"),
            (F.coalesce("at", F.lit(0)) == 0).alias("lead"),
            (F.col("refused").isNull() & taken).alias("mapped"),
        )
    )


VALUE_KEY = [*PERIOD_KEY, "framework", "reporting_currency", "fiscal_year", "fiscal_period", "qname", "rank", "ranks", "unit", "value"]


def _values(mapped: DataFrame) -> DataFrame:
    """One row per distinct disclosed value: its first filing and how many others repeat it."""
    first = F.min(F.struct("filed", "accession", "form", "frame"))
    # A filing may hold a value more than once, with and without a frame; only other filings repeat it.
    filings = mapped.filter("reason IS NULL").groupBy(*VALUE_KEY, "accession").agg(first.alias("first"))
    found = filings.groupBy(*VALUE_KEY).agg(F.min("first").alias("first"), (F.count("*") - 1).alias("repeats"))
    return found.select(*VALUE_KEY, "first.filed", "first.accession", "first.form", "first.frame", "repeats")


def disclosures(mapped: DataFrame) -> DataFrame:
    """One row per distinct disclosed (unit, value) of a metric and period: who disclosed it first, how often it was
    repeated, and the best concept rank seen for the period."""
    same_period = Window.partitionBy(*PERIOD_KEY)
    return _values(mapped).withColumn("best_rank", F.min("rank").over(same_period)).withColumn("chosen", F.col("rank") == F.col("best_rank"))


def to_facts(disclosed: DataFrame, document: Column | None = None) -> DataFrame:
    """The chosen disclosures as facts; every distinct value stays, so restatements coexist."""
    doc = ids.document_id(F.col("company_id"), "structured_facts", F.concat(F.lit("companyfacts:"), "company_id")) if document is None else document
    label = calendar.period_label(F.col("fiscal_year"), F.col("fiscal_period"))
    # The id hashes the value as the source printed it: without the zeros that fixed scale adds.
    printed = F.regexp_replace(F.col("value").cast("string"), r"\.?0+$", "")
    printed = F.when(F.col("value").cast("string").contains("."), printed).otherwise(F.col("value").cast("string"))
    lineage = F.concat_ws("|", "qname", "unit", "accession", printed)
    note = F.concat(F.lit("concept rank "), (F.col("rank") + 1).cast("string"), F.lit(" of "), F.col("ranks").cast("string"))
    repeated = F.concat(F.lit("; repeated in "), F.col("repeats").cast("string"), F.lit(" later filing(s)"))
    return disclosed.filter("chosen").select(
        ids.fact_id(F.col("company_id"), F.col("metric_id"), F.col("period_type"), F.col("period_start"), F.col("period_end"),
                    label, "reported", lineage).alias("fact_id"),
        "company_id", "framework", "metric_id", F.col("value").cast(MONEY).alias("value"),
        F.col("value").cast("double").alias("value_f"), canonical_unit(F.col("unit")).alias("unit"),
        currency_of(F.col("unit")).alias("currency"), "period_type", "period_start", "period_end", "fiscal_year", "fiscal_period",
        F.lit("reported").alias("provenance"), F.lit("xbrl").alias("method"), doc.alias("document_id"), F.col("qname").alias("concept"),
        "accession", "form", "filed", F.array().cast("array<string>").alias("inputs"), F.lit(None).cast("string").alias("formula"),
        F.concat(note, F.when(F.col("repeats") > 0, repeated).otherwise("")).alias("notes"),
    ).select(*FACT_COLUMNS)


def extract_facts(observations: DataFrame, entities: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    return to_facts(disclosures(map_observations(observations, entities, frameworks)))


def _latest() -> list[Column]:
    return [F.coalesce("filed", F.lit("0001-01-01").cast("date")), F.coalesce("accession", F.lit(""))]


def current_facts(facts: DataFrame) -> DataFrame:
    """One fact per (company, metric, period): the latest filed disclosure; ties go by accession, then unit, value and id. Unit is not part of the key."""
    payload = [c for c in facts.columns if c not in PERIOD_KEY]
    newest = F.max_by(F.struct(*payload), F.struct(*_latest(), F.coalesce("unit", F.lit("")), "value", "fact_id"))
    return facts.filter("provenance = 'reported'").groupBy(*PERIOD_KEY).agg(newest.alias("f")).select(*PERIOD_KEY, "f.*").select(*facts.columns)


def current_of(mapped: DataFrame) -> DataFrame:
    """`current_facts` of the disclosures of mapped observations, picked before they become facts: per period the latest
    value of its best-ranked concept in one aggregation, so that ids and notes are worked out for what stays alone."""
    values = _values(mapped)
    payload = [c for c in values.columns if c not in PERIOD_KEY]
    newest = F.max_by(F.struct(*payload), F.struct(-F.col("rank"), *_latest(), F.coalesce(canonical_unit(F.col("unit")), F.lit("")), "value"))
    picked = values.groupBy(*PERIOD_KEY).agg(newest.alias("d")).select(*PERIOD_KEY, "d.*")
    return to_facts(picked.withColumn("chosen", F.lit(True)))


# ---- extraction report ------------------------------------------------------------------------------------------


def skip_counts(mapped: DataFrame, disclosed: DataFrame | None = None) -> DataFrame:
    """(company, reason, n) for every refused observation; optionally also periods disclosed in several units."""
    general = F.col("metric_id").isNull() & F.col("lead")
    counts = (
        mapped.filter(F.col("reason").isNotNull() & (general | F.col("metric_id").isNotNull()))
        .groupBy("company_id", "reason").agg(F.sum("n").alias("n"))
    )
    if disclosed is None:
        return counts
    units = (
        disclosed.filter("chosen").groupBy(*PERIOD_KEY)
        .agg(F.min("unit").alias("low"), F.max("unit").alias("high")).filter("low <> high")
        .groupBy("company_id", F.concat(F.lit("multiple_units_same_period:"), "metric_id").alias("reason")).agg(F.count("*").alias("n"))
    )
    return counts.unionByName(units)


def observation_totals(mapped: DataFrame) -> DataFrame:
    lead = F.when(F.col("lead"), F.col("n")).otherwise(0)
    return mapped.groupBy("company_id").agg(
        F.sum(lead).alias("observations_total"),
        F.sum(F.when(F.col("mapped"), lead).otherwise(0)).alias("observations_mapped"),
    )


def coverage(disclosed: DataFrame) -> DataFrame:
    """Per metric and concept: periods sourced from it and periods in which a better-ranked concept shadowed it."""
    per_period = disclosed.groupBy(*PERIOD_KEY, "qname", "rank").agg(
        F.first("chosen").alias("chosen"), F.first("fiscal_year").alias("fiscal_year"), F.first("fiscal_period").alias("fiscal_period")
    )
    return per_period.groupBy("company_id", "metric_id", F.col("qname").alias("concept")).agg(
        F.count_if("chosen").alias("periods_used"), F.count_if(~F.col("chosen")).alias("periods_shadowed")
    )


def concept_switches(covered: DataFrame) -> DataFrame:
    """Metrics whose periods come from more than one concept, with the concepts in use."""
    return (
        covered.filter("periods_used > 0").groupBy("company_id", "metric_id")
        .agg(F.count("*").alias("n_concepts"), F.array_sort(F.collect_set("concept")).alias("concepts"))
        .filter("n_concepts > 1")
    )


def restatements(disclosed: DataFrame) -> DataFrame:
    """One row per version of every restated (metric, period, unit), numbered in filing order."""
    same = Window.partitionBy(*PERIOD_KEY)
    units = Window.partitionBy(*PERIOD_KEY, "unit")
    return (
        disclosed.filter("chosen")
        .withColumn("in_unit", F.count("*").over(units))
        .withColumn("restated", F.max("in_unit").over(same) > 1)
        .filter("restated")
        .withColumn("version", F.row_number().over(same.orderBy("filed", "accession", "unit", "value")))
        .select(
            "company_id", "metric_id", "period_type", "period_end",
            calendar.period_label(F.col("fiscal_year"), F.col("fiscal_period")).alias("period"),
            "version", "value", "unit", "accession", "form", "filed",
        )
    )


def currency_mismatches(facts: DataFrame, entities: DataFrame) -> DataFrame:
    expected = entities.select("company_id", "reporting_currency").filter("reporting_currency IS NOT NULL")
    return (
        facts.join(expected, "company_id").filter("currency <> reporting_currency")
        .groupBy("company_id", "metric_id", "currency").agg(F.count("*").alias("n"))
    )


def missing_metrics(entities: DataFrame, facts: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    """Metrics of a company's framework with no fact, and why: no data, formula only, or documents only."""
    specs = metric_spec(facts.sparkSession, frameworks)
    expected = entities.select("company_id", "framework").join(specs, "framework")
    return expected.join(facts.select("company_id", "metric_id").distinct(), ["company_id", "metric_id"], "left_anti").select(
        "company_id", "metric_id",
        F.when(F.col("has_concepts"), "without_data").when(F.col("derivation").isNotNull(), "derivation_only").otherwise("requires_documents").alias("class"),
    )
