"""Fixed schemas. Every dataset is long and typed; wide layouts exist only as pivots for output."""

from __future__ import annotations

MONEY = "decimal(28,8)"

OBSERVATIONS = (
    f"company_id string, taxonomy string, concept string, unit string, value {MONEY}, period_start date, "
    "period_end date, accession string, form string, filed date, frame string"
)

ENTITIES = (
    "company_id string, cik string, name string, tickers array<string>, exchanges array<string>, sic int, "
    "fye_month int, convention string, reporting_currency string, framework string"
)

# `value` is exact; `value_f` is the same number as a double, kept because a derived ratio has more digits than
# eight decimal places can hold.
FACTS = (
    "fact_id string, company_id string, framework string, metric_id string, "
    f"value {MONEY}, value_f double, unit string, currency string, period_type string, period_start date, "
    "period_end date, fiscal_year int, fiscal_period string, provenance string, method string, document_id string, "
    "concept string, accession string, form string, filed date, inputs array<string>, formula string, notes string"
)
FACT_COLUMNS = [part.strip().split(" ")[0] for part in FACTS.replace("decimal(28,8)", "decimal").split(",")]

ISSUES = (
    "company_id string, check_id string, severity string, metric_id string, period string, "
    "fact_ids array<string>, details map<string,string>"
)

ANALYTICS = (
    "value_id string, company_id string, analytic_id string, fiscal_year int, value double, currency string, "
    "formula string, basis string, input_fact_ids array<string>, input_value_ids array<string>, "
    "quality_flags array<string>, uses_derived boolean"
)

ASSUMPTIONS = (
    "company_id string, key string, value double, unit string, period string, type string, scenario string, "
    "description string, rationale string, source_document_id string, source_fact_ids array<string>"
)

FORECAST = (
    "value_id string, company_id string, scenario string, metric_id string, fiscal_year int, value double, "
    "unit_kind string, currency string, method string, formula string, assumption_ids array<string>, "
    "assumption_types array<string>, input_value_ids array<string>, input_fact_ids array<string>, "
    "fallback_for array<string>"
)
