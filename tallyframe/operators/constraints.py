"""Row constraints as violation queries: rows that break a rule, with the rule's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, id_column: str, rules: dict[str, Column]) -> DataFrame:
    """One pass over the rows: each becomes as many (rule, id) rows as it breaks rules."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(id_column).alias("row_id"))


def _no_items(column: str) -> Column:
    return F.coalesce(F.size(column), F.lit(0)) <= 0


def fact_violations(facts: DataFrame) -> DataFrame:
    c = F.col
    reported, derived = c("provenance") == "reported", c("provenance") == "derived"
    flow = c("period_type") == "duration"
    return violations(facts, "fact_id", {
        "duration_needs_start": flow & c("period_start").isNull(),
        "instant_has_start": ~flow & c("period_start").isNotNull(),
        "start_not_before_end": flow & (c("period_start") >= c("period_end")),
        "fiscal_year_out_of_range": ~c("fiscal_year").between(1900, 2200),
        "unknown_period_code": ~c("fiscal_period").isin("FY", "Q1", "Q2", "Q3", "Q4", "H1", "H2", "9M"),
        "reported_without_source": reported & c("document_id").isNull(),
        "source_not_pinned": reported & c("document_id").isNotNull() & c("concept").isNull() & c("notes").isNull(),
        "bad_accession": c("accession").isNotNull() & ~c("accession").rlike(r"^\d{10}-\d{2}-\d{6}$"),
        "reported_with_inputs": reported & (~_no_items("inputs") | c("formula").isNotNull()),
        "reported_but_computed": reported & (c("method") == "computed"),
        "derived_with_source": derived & c("document_id").isNotNull(),
        "derived_without_inputs": derived & (_no_items("inputs") | c("formula").isNull()),
        "derived_not_computed": derived & (c("method") != "computed"),
        "unit_against_currency": c("currency").isNotNull() & ~F.startswith(c("unit"), c("currency")),
        "value_not_finite": c("value").isNull(),
    })


def duplicate_current(facts: DataFrame) -> DataFrame:
    """Metrics with two current facts for one period."""
    key = ["company_id", "metric_id", "period_type", "period_start", "period_end"]
    return facts.groupBy(*key).agg(F.count("*").alias("n"), F.min("fact_id").alias("first_fact_id")).filter("n > 1")


def analytic_violations(values: DataFrame) -> DataFrame:
    bad_ids = F.exists("input_fact_ids", lambda i: ~i.rlike("^fact_[0-9a-f]{16}$"))
    return violations(values, "value_id", {
        "no_inputs": _no_items("input_fact_ids") & _no_items("input_value_ids"),
        "bad_fact_id": bad_ids, "value_not_finite": F.col("value").isNull() | F.isnan("value"),
    })


def assumption_violations(assumptions: DataFrame) -> DataFrame:
    c, kind = F.col, F.col("type")
    cited = c("source_document_id").isNotNull()
    return violations(assumptions, "key", {
        "outlook_without_document": kind.isin("management_guidance", "consensus") & ~cited,
        "measured_without_facts": kind.isin("historical", "derived") & _no_items("source_fact_ids"),
        "analyst_without_rationale": (kind == "analyst_assumption") & c("rationale").isNull(),
        "scenario_incomplete": (kind == "scenario") & (c("scenario").isNull() | c("rationale").isNull()),
        "scenario_on_other_type": (kind != "scenario") & c("scenario").isNotNull(),
        "bad_period": c("period").isNotNull() & ~c("period").rlike(r"^(FY\d{4}|(Q[1-4]|H[12]|9M)-\d{4})$"),
        "bad_key": ~c("key").rlike(r"^[a-z][a-z0-9_.\-]*$"),
    })


def forecast_violations(forecast: DataFrame) -> DataFrame:
    method = F.col("method")
    return violations(forecast, "value_id", {
        "assumption_types_differ": F.size("assumption_ids") != F.size("assumption_types"),
        "actual_without_fact": (method == "actual") & _no_items("input_fact_ids"),
        "actual_with_assumption": (method == "actual") & ~_no_items("assumption_ids"),
        "exogenous_without_assumption": method.isin("growth", "level") & _no_items("assumption_ids"),
        "computed_without_inputs": method.isin("driver_formula", "derivation") & _no_items("input_value_ids") & _no_items("assumption_ids"),
        "value_not_finite": F.col("value").isNull() | F.isnan("value"),
    })


def document_violations(documents: DataFrame) -> DataFrame:
    has_content = F.col("status").isin("retrieved", "parsed", "extracted", "superseded")
    return violations(documents, "document_id", {
        "content_without_hash": has_content & F.col("hash").isNull(), "hash_without_content": (F.col("status") == "registered") & F.col("hash").isNotNull(),
    })
