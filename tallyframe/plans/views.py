"""Serving views: what a dashboard or a notebook reads, as DataFrames over stage outputs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display
from ..functions.calendar import period_label
from ..session import spec_frame
from ..sources.specs import Framework, analytic_spec, metric_spec
from .projection import Plan, needs, plan_table

STAGES = ("ingest", "quality", "analyze", "forecast")


class StageNotRun(LookupError):
    """A stage has not run for a company; that is an answer of its own, never an empty result."""


def require_stage(manifests: DataFrame, company_id: str, stage: str) -> None:
    if manifests.filter((F.col("company_id") == company_id) & (F.col("stage") == stage)).isEmpty():
        raise StageNotRun(f"{company_id}: run `{stage}` first")


def stage_answers(asked: DataFrame, manifests: DataFrame) -> DataFrame:
    """(company_id, stage, ran, answer) for every stage asked for; the answer says what to run where it has not run."""
    done = manifests.select("company_id", "stage").distinct().withColumn("ran", F.lit(True))
    found = asked.join(done, ["company_id", "stage"], "left").withColumn("ran", F.coalesce("ran", F.lit(False)))
    return found.withColumn("answer", F.when(~F.col("ran"), F.concat("company_id", F.lit(": run `"), "stage", F.lit("` first"))))


def company_list(entities: DataFrame, manifests: DataFrame) -> DataFrame:
    """Companies with the stages present, in pipeline order. manifests: (company_id, stage)."""
    order = F.array(*[F.lit(s) for s in STAGES])
    done = manifests.groupBy("company_id").agg(F.collect_set("stage").alias("done"))
    return entities.join(done, "company_id", "left").withColumn(
        "stages", F.filter(order, lambda s: F.array_contains(F.coalesce("done", F.array().cast("array<string>")), s))).drop("done")


def overview(companies: DataFrame, **counted: DataFrame) -> DataFrame:
    """One row per company with the number of rows in each named dataset; a company without rows shows zero."""
    out = companies.select("company_id")
    for name, df in counted.items():
        out = out.join(df.groupBy("company_id").agg(F.count("*").alias(f"n_{name}")), "company_id", "left")
    return out.fillna(0)


def statement_view(facts: DataFrame, frameworks: dict[str, Framework], documents: DataFrame | None = None) -> DataFrame:
    """Full-year figures by statement and line, each year with its fact, origin and filing. Years per line are few."""
    spec = metric_spec(facts.sparkSession, frameworks).select("framework", "metric_id", "name", "unit_kind", "statement", "position")
    rows = facts.filter("fiscal_period = 'FY'").join(spec, ["framework", "metric_id"])
    if documents is not None:
        rows = rows.join(documents.select("document_id", F.col("title").alias("document_title")), "document_id", "left")
    else:
        rows = rows.withColumn("document_title", F.lit(None).cast("string"))
    cell = F.struct("fiscal_year", F.col("value_f").alias("value"), "fact_id", (F.col("provenance") == "derived").alias("derived"), "form", "filed", "document_title")
    lines = rows.groupBy("company_id", "statement", "metric_id", "name", "unit_kind", "position").agg(F.array_sort(F.collect_list(cell)).alias("years"), F.first("currency", ignorenulls=True).alias("currency"))
    return lines.withColumn("statement_label", display.lookup(display.STATEMENT_LABELS, F.col("statement")))


def analytics_view(values: DataFrame, summaries: DataFrame, gaps: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    """Series with their points, statistics and gap text. A series has one point per fiscal year."""
    spec = analytic_spec(values.sparkSession, frameworks).select("framework", "analytic_id", "name", "category", "position")
    point = F.struct("fiscal_year", "value", "basis", "quality_flags", "uses_derived", "value_id")
    series = values.join(spec, ["framework", "analytic_id"]).groupBy("company_id", "analytic_id", "name", "category", "position").agg(F.array_sort(F.collect_list(point)).alias("points"))
    missing = gaps.select("company_id", F.col("item").alias("analytic_id"), F.col("total").alias("gap_count"), F.col("reasons").alias("gap_reasons"))
    return series.join(summaries, ["company_id", "analytic_id"], "left").join(missing, ["company_id", "analytic_id"], "left")


def forecast_view(values: DataFrame, frame: DataFrame, plans: list[Plan]) -> DataFrame:
    """Projected lines per scenario in plan order. frame: (company_id, signature)."""
    plan = plan_table(values.sparkSession, plans).select("signature", "metric_id", "position", "driver_id", "fallback")
    point = F.struct("fiscal_year", "value", "method", "assumption_ids", "assumption_types", "value_id", "fallback_for")
    lines = values.groupBy("company_id", "scenario", "metric_id", "unit_kind").agg(F.array_sort(F.collect_list(point)).alias("points"), F.first("currency", ignorenulls=True).alias("currency"))
    return lines.join(frame.select("company_id", "signature").distinct(), "company_id").join(plan, ["signature", "metric_id"], "left")


def fallback_notes(frame: DataFrame, plans: list[Plan], frameworks: dict[str, Framework]) -> DataFrame:
    """(company_id, metric_id, label, text): metrics that follow their own trend as inputs of their driver have no value in
    the base year, with those inputs. frame: (company_id, signature, base: map of metrics with a value)."""
    rows = []
    for p in plans:
        for m in p.fallbacks:
            modelling = next(d.id for d in reversed(list(p.framework.drivers.values())) if d.formula and m in d.affects)
            inputs = [p.framework.metrics[n] for n in needs(p.framework, modelling)]
            rows.append({"signature": p.signature, "metric_id": m, "label": p.framework.metrics[m].name,
                         "inputs": [{"id": i.id, "name": i.name, "only": bool(i.document_only)} for i in inputs]})
    s = pa.string()
    spec = spec_frame(frame.sparkSession, rows, pa.schema([("signature", s), ("metric_id", s), ("label", s), ("inputs", pa.list_(pa.struct([("id", s), ("name", s), ("only", pa.bool_())])))]))
    found = frame.select("company_id", "signature", F.map_keys("base").alias("known")).join(spec, "signature")
    found = found.withColumn("missing", F.filter("inputs", lambda i: ~F.array_contains("known", i["id"]))).filter("size(missing) > 0")
    said = F.transform("missing", lambda i: display.in_sentence(i["name"]))
    all_ = F.when(F.size("missing") == 1, said[0]).otherwise(F.concat(F.array_join(F.slice(said, F.lit(1), F.size("missing") - 1), ", "), F.lit(" and "), F.element_at(said, -1)))
    where = F.when(F.exists("missing", lambda i: i["only"]), " disclosed in the SEC's structured financial data.").otherwise(" reported.")
    text = F.concat("label", F.lit(" is estimated from its own recent trend because "), all_, F.when(F.size("missing") > 1, " aren't").otherwise(" isn't"), where)
    return found.select("company_id", "metric_id", "label", text.alias("text"))


def forecast_table(values: DataFrame, years: list[int]) -> DataFrame:
    """Scenario by year for every metric, base first; years are passed in, so the pivot needs no extra pass."""
    order = F.when(F.col("scenario") == "base", 0).otherwise(1)
    wide = values.groupBy("company_id", "metric_id", "scenario").pivot("fiscal_year", years).agg(F.first("value"))
    return wide.select("company_id", "metric_id", "scenario", order.alias("scenario_order"), *[F.col(str(y)).alias(f"FY{y}") for y in years])


def assumptions_view(assumptions: DataFrame, entities: DataFrame, names: DataFrame) -> DataFrame:
    """Assumptions with their label and basis in words."""
    span = F.regexp_extract("description", r"over (FY\d{4})(?:-(FY\d{4}))?", 1), F.regexp_extract("description", r"over (FY\d{4})(?:-(FY\d{4}))?", 2)
    measured = F.when(span[1] == "", F.concat(span[0], F.lit(" only"))).otherwise(F.concat(F.lit("Median, "), span[0], F.lit("–"), span[1]))
    basis = F.when((F.col("type") == "historical") & (span[0] != ""), measured).otherwise(F.coalesce("rationale", "description", F.lit("")))
    label = names.select("framework", F.col("item").alias("key"), F.col("name").alias("label"))
    return assumptions.join(entities.select("company_id", "framework"), "company_id").join(label, ["framework", "key"], "left").withColumn("label", F.coalesce("label", "key")).withColumn("basis_text", basis)


def checks_view(issues: DataFrame, entities: DataFrame, names: DataFrame) -> DataFrame:
    """Findings as sentences, most severe first within a company when ordered by severity_order and check_label."""
    who = entities.select("company_id", "framework", "reporting_currency")
    severity = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return display.issue_text(issues.join(who, "company_id"), names, F.col("reporting_currency")).withColumn("severity_order", severity)


def chart_points(plotted: DataFrame, facts: DataFrame, values: DataFrame) -> DataFrame:
    """Each plotted id with its value under its own fiscal year. plotted: (company_id, chart_id, series_id, lineage_ids)."""
    ids = plotted.select("company_id", "chart_id", "series_id", F.posexplode("lineage_ids").alias("place", "lineage_id"))
    known = facts.select(F.col("fact_id").alias("lineage_id"), "fiscal_year", F.col("value_f").alias("value"), "currency").unionByName(
        values.select(F.col("value_id").alias("lineage_id"), "fiscal_year", "value", "currency"))
    return ids.join(known, "lineage_id")


def chart_table(points: DataFrame, years: list[int]) -> DataFrame:
    wide = points.groupBy("company_id", "chart_id", "series_id").pivot("fiscal_year", years).agg(F.first("value"))
    return wide.select("company_id", "chart_id", "series_id", *[F.col(str(y)).alias(f"FY{y}") for y in years])


def charts(spark: SparkSession, frameworks: dict[str, Framework]) -> DataFrame:
    rows = [{"framework": f.name, "chart_id": c.id, "title": c.title, "kind": c.kind, "series_id": s, "format": c.format, "place": i}
            for f in frameworks.values() for c in f.charts.values() for i, s in enumerate(c.series)]
    s = pa.string()
    return spec_frame(spark, rows, pa.schema([("framework", s), ("chart_id", s), ("title", s), ("kind", s), ("series_id", s), ("format", s), ("place", pa.int32())]))


def library_view(library: DataFrame, reports: DataFrame) -> DataFrame:
    """Library entries with their verdict in words; a document not read yet is waiting, not missing."""
    joined = library.join(reports, "doc_id", "left")
    status = F.coalesce("status", F.lit("pending"))
    label = F.when((status == "verified") & (F.coalesce("contributed", F.lit(0)) == 0), "Checked — nothing new").otherwise(display.lookup(display.STATUS_LABELS, status, status))
    return joined.withColumn("status_label", label).withColumn("reason", F.coalesce("reason", F.lit("It will be read on the next analysis run.")))


def glossary(spark: SparkSession, frameworks: dict[str, Framework]) -> DataFrame:
    """Names, order, units and groups of everything a framework produces."""
    metrics = metric_spec(spark, frameworks).select("framework", F.col("metric_id").alias("item"), "name", "unit_kind", F.col("statement").alias("item_group"), "position", F.lit("metric").alias("kind"))
    analytics = analytic_spec(spark, frameworks).select("framework", F.col("analytic_id").alias("item"), "name", "unit_kind", F.col("category").alias("item_group"), "position", F.lit("analytic").alias("kind"))
    only = display.name_table(spark, frameworks).select("framework", "item", "document_only")
    return metrics.unionByName(analytics).join(only, ["framework", "item"])


def traceable_ids(facts: DataFrame, values: DataFrame, forecast: DataFrame) -> DataFrame:
    return facts.filter("fiscal_period = 'FY'").select(F.col("fact_id").alias("id")).unionByName(values.select(F.col("value_id").alias("id"))).unionByName(
        forecast.select(F.col("value_id").alias("id"))).distinct()


def financials_long(facts: DataFrame) -> DataFrame:
    return facts.withColumn("period", period_label(F.col("fiscal_year"), F.col("fiscal_period")))
