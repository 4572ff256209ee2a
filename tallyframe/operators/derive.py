"""Derived facts: missing interim periods from year-to-date values, then framework formulas.

Reported always wins and derived never overwrites. Each step first emits one event per attempt (derived, or why
not), so counters and facts come from the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar, ids
from ..functions.calendar import HALF_DAYS, PERIOD_ORDER, QUARTER_DAYS
from ..functions.formula import formula
from ..functions.numeric import rounding_tolerance
from ..schemas import FACT_COLUMNS, MONEY
from ..sources.specs import Framework, Metric, metric_spec, ordered_layers

# Target, whole, parts taken off it, allowed length. Year-to-date differences come first.
INTERIM_RULES = (
    ("Q2", "H1", ("Q1",), QUARTER_DAYS),
    ("Q3", "9M", ("H1",), QUARTER_DAYS),
    ("Q4", "FY", ("9M",), QUARTER_DAYS),
    ("H2", "FY", ("H1",), HALF_DAYS),
    ("Q3", "9M", ("Q1", "Q2"), QUARTER_DAYS),
    ("Q4", "FY", ("Q1", "Q2", "Q3"), QUARTER_DAYS),
)
PERIOD_NAMES = {"FY": "annual", "H1": "first_half", "9M": "nine_month_ytd", "Q1": "q1", "Q2": "q2", "Q3": "q3"}
_CELL = ["period_start", "period_end", "value", "value_f", "unit", "currency", "fact_id"]


def interim_events(facts: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    """One row per (company, metric, fiscal year, rule that applied) with its outcome and, if derived, the fact."""
    specs = metric_spec(facts.sparkSession, frameworks).select("framework", "metric_id", "additive")
    flows = facts.filter("period_type = 'duration'").join(specs, ["framework", "metric_id"]).filter("additive")
    # A fiscal year holds at most eight codes; when two facts share one, the later end wins.
    latest = [
        F.max_by(F.struct(*_CELL), F.when(F.col("fiscal_period") == code, F.struct("period_end", "period_start"))).alias(code)
        for code in PERIOD_ORDER
    ]
    years = flows.groupBy("company_id", "framework", "metric_id", "fiscal_year").agg(*latest)

    for number, (target, whole, parts, length) in enumerate(INTERIM_RULES):
        total, pieces = F.col(whole), [F.col(p) for p in parts]
        last = pieces[-1]
        start, end = F.date_add(last["period_end"], 1), total["period_end"]
        linked = [nxt["period_start"] == F.date_add(prev["period_end"], 1) for prev, nxt in zip(pieces, pieces[1:], strict=False)]
        contiguous = reduce(lambda a, b: a & b, linked, (pieces[0]["period_start"] == total["period_start"]) & (last["period_end"] < end))
        one_unit = reduce(lambda a, b: a & b, [p["unit"] == total["unit"] for p in pieces])
        present = reduce(lambda a, b: a & b, [p.isNotNull() for p in pieces], total.isNotNull() & F.col(target).isNull())
        outcome = F.when(
            present,
            F.when(~contiguous, "interim_periods_not_contiguous")
            .when(~one_unit, "interim_mixed_units")
            .when(~calendar.days_inclusive(start, end).between(*length), "interim_period_length_unexpected")
            .otherwise("derived"),
        )
        inputs = F.array(total["fact_id"], *[p["fact_id"] for p in pieces])
        text = " - ".join(PERIOD_NAMES[c] for c in (whole, *parts))
        value = reduce(lambda a, b: a - b, [p["value"] for p in pieces], total["value"]).cast(MONEY)
        new_id = ids.fact_id(
            F.col("company_id"), F.col("metric_id"), "duration", start, end, calendar.period_label(F.col("fiscal_year"), F.lit(target)),
            "derived", F.concat_ws("|", F.lit(text), ids.joined_sorted(inputs)),
        )
        cell = F.struct(
            start.alias("period_start"), end.alias("period_end"), value.alias("value"), value.cast("double").alias("value_f"),
            total["unit"].alias("unit"), total["currency"].alias("currency"), new_id.alias("fact_id"),
        )
        note = f"{target} derived from {whole} less {', '.join(parts)}"
        event = F.struct(
            F.lit(target).alias("target"), outcome.alias("outcome"), F.when(outcome == "derived", cell).alias("cell"),
            inputs.alias("inputs"), F.lit(text).alias("formula"), F.lit(note).alias("notes"),
        )
        years = years.withColumn(f"_e{number}", F.when(outcome.isNotNull(), event))
        years = years.withColumn(target, F.coalesce(F.col(target), F.col(f"_e{number}.cell")))
    events = F.array_compact(F.array(*[F.col(f"_e{i}") for i in range(len(INTERIM_RULES))]))
    return years.select("company_id", "framework", "metric_id", "fiscal_year", F.explode(events).alias("e")).select(
        "company_id", "framework", "metric_id", "fiscal_year", "e.*"
    )


def _as_facts(df: DataFrame) -> DataFrame:
    """Fill in what every derived fact shares."""
    nothing = F.lit(None).cast("string")
    return df.select(
        "*", F.lit("derived").alias("provenance"), F.lit("computed").alias("method"), nothing.alias("document_id"), nothing.alias("concept"),
        nothing.alias("accession"), nothing.alias("form"), F.lit(None).cast("date").alias("filed"),
    ).select(*FACT_COLUMNS)


def interim_facts(events: DataFrame) -> DataFrame:
    done = events.filter("outcome = 'derived'")
    return _as_facts(
        done.select(
            "company_id", "framework", "metric_id", "fiscal_year", F.col("target").alias("fiscal_period"), "inputs", "formula", "notes",
            F.lit("duration").alias("period_type"), "cell.*",
        )
    )


# ---- framework formulas -----------------------------------------------------------------------------------------


def anchor_frame(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of one anchor as a map. A map holds at most the framework's metrics; two current facts for the same
    metric and period are a defect of the input and fail here rather than picking one silently."""
    cell = F.struct("fact_id", "value", "value_f", "unit", "currency", (F.col("provenance") == "derived").alias("derived"))
    return facts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("metric_id", cell))).alias("m"),
        F.first("fiscal_year").alias("fiscal_year"), F.first("fiscal_period").alias("fiscal_period"),
    )


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _formula_event(metric: Metric, traced: bool = True) -> Column:
    parsed = formula(metric.derivation)
    cells = {n: F.col("m")[n] for n in parsed.names}
    terms, existing = list(cells.values()), F.col("m")[metric.id]
    if parsed.additive:
        exact = parsed.column(lambda n: cells[n]["value"]).cast(MONEY)
        loose = exact.cast("double")
    else:
        loose = parsed.column(lambda n: cells[n]["value_f"])
        exact = loose.cast(MONEY)
    tolerance = rounding_tolerance(F.array(existing["value"], *[t["value"] for t in terms]))
    currencies = F.array_distinct(F.array_compact(F.array(*[t["currency"] for t in terms])))
    currency = F.try_element_at(currencies, F.lit(1))
    needs_currency = metric.unit_kind in ("currency", "currency_per_share")
    unit = {
        "currency": currency, "currency_per_share": F.concat(currency, F.lit("/share")), "ratio": F.lit("pure"), "count": F.lit("count"),
    }[metric.unit_kind]
    if parsed.additive:
        against = F.when(_any([t["derived"] for t in terms]), "not_evaluable").when(F.abs(exact - existing["value"]) <= tolerance, "passed").otherwise("failed")
    else:
        against = F.lit("not_evaluable")
    complete = _all([t.isNotNull() for t in terms])
    outcome = F.when(
        _any([t.isNotNull() for t in terms]),
        F.when(~complete, F.when(existing.isNull(), "inputs_missing").otherwise("not_evaluable"))
        .when(existing.isNotNull(), against)
        .when(F.size(currencies) > 1, "mixed_currency")
        .when(F.lit(needs_currency) & (F.size(currencies) == 0), "no_currency_input")
        .when(exact.isNull(), "division_by_zero")
        .otherwise("derived"),
    )
    inputs = F.array(*[t["fact_id"] for t in terms])
    note = F.lit(f"computed from framework definition {metric.derivation}")
    if metric.unit_kind == "ratio":
        interim = (F.col("period_type") == "duration") & (F.col("fiscal_period") != "FY")
        note = F.concat(note, F.when(interim, "; interim-period ratio, not annualised").otherwise(""))
    new_id = ids.fact_id(
        F.col("company_id"), metric.id, F.col("period_type"), F.col("period_start"), F.col("period_end"),
        calendar.period_label(F.col("fiscal_year"), F.col("fiscal_period")), "derived",
        F.concat_ws("|", F.lit(metric.derivation), ids.joined_sorted(inputs)),
    )
    if not traced:
        new_id = F.lit(None).cast("string")
    cell = F.struct(
        new_id.alias("fact_id"), exact.alias("value"), loose.alias("value_f"), unit.alias("unit"),
        (currency if needs_currency else F.lit(None).cast("string")).alias("currency"), F.lit(True).alias("derived"),
    )
    if not traced:
        return F.when(outcome.isNotNull(), F.struct(F.lit(metric.id).alias("metric_id"), outcome.alias("outcome"), F.when(outcome == "derived", cell).alias("cell")))
    return F.when(
        outcome.isNotNull(),
        F.struct(
            F.lit(metric.id).alias("metric_id"), outcome.alias("outcome"), F.when(outcome == "derived", cell).alias("cell"), inputs.alias("inputs"),
            F.lit(metric.derivation).alias("formula"), note.alias("notes"), existing["fact_id"].alias("reported_id"),
            existing["value"].alias("reported"), exact.alias("computed"), tolerance.alias("tolerance"),
        ),
    )


def formula_events(facts: DataFrame, frameworks: dict[str, Framework], traced: bool = True) -> DataFrame:
    """One row per (company, anchor period, formula metric) that had any input, layer by dependency layer.

    Not traced: outcomes alone, for who only counts them; ids, inputs, notes and tolerances are not worked out where no
    outcome stands on them.
    """
    keys = ["company_id", "framework", "period_type", "period_start", "period_end"]
    anchors = anchor_frame(facts, keys)
    found = []
    for framework in frameworks.values():
        derived = {m.id: m for m in framework.metrics.values() if m.derivation}
        if not derived:
            continue
        frame = anchors.filter(F.col("framework") == framework.name)
        layers = ordered_layers({mid: formula(m.derivation).names for mid, m in derived.items()})
        for depth, layer in enumerate(layers):
            frame = frame.withColumn(f"_l{depth}", F.array_compact(F.array(*[_formula_event(derived[mid], traced) for mid in layer])))
            if depth + 1 < len(layers):
                fresh = F.filter(f"_l{depth}", lambda e: e["cell"].isNotNull())
                frame = frame.withColumn(
                    "m", F.map_concat("m", F.map_from_entries(F.transform(fresh, lambda e: F.struct(e["metric_id"], e["cell"]))))
                )
        events = F.flatten(F.array(*[F.col(f"_l{d}") for d in range(len(layers))]))
        found.append(frame.select(*keys, "fiscal_year", "fiscal_period", F.explode(events).alias("e")).select(*keys, "fiscal_year", "fiscal_period", "e.*"))
    return reduce(DataFrame.unionByName, found)


def formula_facts(events: DataFrame) -> DataFrame:
    return _as_facts(events.filter("outcome = 'derived'").select(
        "company_id", "framework", "period_type", "period_start", "period_end", "fiscal_year", "fiscal_period", "metric_id",
        "inputs", "formula", "notes", "cell.fact_id", "cell.value", "cell.value_f", "cell.unit", "cell.currency",
    ))


def formula_issues(events: DataFrame) -> DataFrame:
    """A reported value that disagrees with its own additive definition beyond rounding: a warning."""
    text = lambda c: F.col(c).cast("string")
    return events.filter("outcome = 'failed'").select(
        "company_id", F.concat(F.lit("derivation:"), "metric_id").alias("check_id"), F.lit("warning").alias("severity"), "metric_id",
        calendar.period_label(F.col("fiscal_year"), F.col("fiscal_period")).alias("period"),
        F.concat(F.array("reported_id"), F.col("inputs")).alias("fact_ids"),
        F.create_map(F.lit("reported"), text("reported"), F.lit("computed"), text("computed"), F.lit("tolerance"), text("tolerance"),
                     F.lit("formula"), F.col("formula")).alias("details"),
    )


def formula_outcomes(events: DataFrame) -> DataFrame:
    return events.filter("outcome IN ('passed', 'failed', 'not_evaluable')").select(
        "company_id", F.concat(F.lit("derivation:"), "metric_id").alias("check_id"), "outcome"
    )


def derivation_counts(facts: DataFrame, interim: DataFrame, formulas: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    """(company, event, n) over every derivation attempt, including metrics whose parts do not add up to a year."""
    specs = metric_spec(facts.sparkSession, frameworks).select("framework", "metric_id", "additive")
    rigid = (
        facts.filter("period_type = 'duration' AND fiscal_period = 'FY'").join(specs, ["framework", "metric_id"]).filter("NOT additive")
        .select("company_id", F.concat(F.lit("interim_not_derivable_non_additive:"), "metric_id").alias("event")).distinct()
    )
    tried = interim.select("company_id", F.when(F.col("outcome") == "derived", F.concat(F.lit("interim:"), "target")).otherwise(F.concat_ws(":", "outcome", "metric_id")).alias("event"))
    counted = formulas.filter("outcome NOT IN ('passed', 'failed', 'not_evaluable')").select(
        "company_id", F.when(F.col("outcome") == "derived", F.concat(F.lit("framework:"), "metric_id")).when(
            F.col("outcome") == "inputs_missing", F.concat(F.lit("derivation_inputs_missing:"), "metric_id")
        ).otherwise(F.concat(F.lit("derivation_"), "outcome", F.lit(":"), "metric_id")).alias("event"),
    )
    return rigid.unionByName(tried).unionByName(counted).groupBy("company_id", "event").agg(F.count("*").alias("n"))
