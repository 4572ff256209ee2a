"""Deterministic ids: a prefix and the first sixteen hex digits of a SHA-256 over pipe-joined keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part: Column | str) -> Column:
    column = F.lit(part) if isinstance(part, str) else part
    return F.coalesce(column.cast("string"), F.lit(""))


def hashed(prefix: str, *parts: Column | str) -> Column:
    joined = F.concat_ws("|", *[_text(p) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 16))


def joined_sorted(ids: Column) -> Column:
    return F.array_join(F.array_sort(ids), "|")


def fact_id(company, metric, period_type, start, end, label, provenance, lineage_key) -> Column:
    return hashed("fact_", company, metric, period_type, start, end, label, provenance, lineage_key)


def _with_inputs(prefix: str, keys: list, inputs: Column) -> Column:
    # An empty input list adds no separator.
    everything = F.array_join(F.concat(F.array(*[_text(k) for k in keys]), F.array_sort(inputs)), "|")
    return F.concat(F.lit(prefix), F.substring(F.sha2(everything, 256), 1, 16))


def analytic_id(company, analytic, year, inputs: Column) -> Column:
    return _with_inputs("ana_", [company, analytic, year], inputs)


def forecast_id(company, scenario, metric, year, inputs: Column) -> Column:
    return _with_inputs("fcv_", [company, scenario, metric, year], inputs)


def document_id(company, kind, source) -> Column:
    return hashed("doc_", company, kind, source)
