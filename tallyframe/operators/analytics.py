"""Annual analytics with named refusals, gated by data quality.

All years of a company sit in one hash partition of one row per fiscal year, holding that year's facts as a map. Each
dependency layer of the framework then adds its results as columns, so the whole catalogue needs one shuffle. A year's
map is bounded by the framework's metrics and a company's rows by the calendar.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, ids
from ..functions.formula import formula
from ..sources.specs import Analytic, Framework, ordered_layers

NO_IDS = "array<string>"


def growth_refusal(previous: Column, current: Column) -> Column:
    """Growth has a meaning only between two positive values; null when it does."""
    return F.when(previous.isNull() | (previous <= 0), "growth_base_not_positive").when(
        current.isNull() | (current <= 0), "growth_sign_change"
    )


# ---- quality gate -----------------------------------------------------------------------------------------------


def gate(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """Facts with `blocked` (the first error check that names them) and `flags` (warning checks that travel on)."""
    order = F.struct("check_id", F.coalesce("metric_id", F.lit("")), F.coalesce("period", F.lit("")))
    serious = issues.filter("severity IN ('error', 'warning')")
    named = serious.select("company_id", "severity", "check_id", order.alias("at"), F.explode("fact_ids").alias("fact_id"))
    is_error = F.col("severity") == "error"
    by_fact = named.groupBy("company_id", "fact_id").agg(
        F.min(F.when(is_error, F.col("at"))).alias("first_error"),
        F.array_sort(F.collect_set(F.when(~is_error, F.col("check_id")))).alias("flags"),
    )
    whole_periods = serious.filter("severity = 'error' AND size(fact_ids) = 0 AND metric_id IS NOT NULL AND period IS NOT NULL")
    by_period = whole_periods.groupBy("company_id", "metric_id", F.col("period").alias("label")).agg(F.min(order).alias("period_error"))
    labelled = facts.withColumn("label", calendar.period_label(F.col("fiscal_year"), F.col("fiscal_period")))
    return (
        labelled.join(by_fact, ["company_id", "fact_id"], "left").join(by_period, ["company_id", "metric_id", "label"], "left")
        .withColumn("blocked", F.coalesce("first_error.check_id", "period_error.check_id"))
        .withColumn("flags", F.coalesce("flags", F.array().cast(NO_IDS)))
        .drop("label", "first_error", "period_error")
    )


def annual_frame(gated: DataFrame) -> DataFrame:
    """One row per company and fiscal year: this year's facts `m`, last year's facts `pm` (empty if there is no last
    year). When two facts share a metric and year, a derived one wins, then the later end."""
    cell = F.struct("fact_id", F.col("value_f").alias("value"), "currency", (F.col("provenance") == "derived").alias("derived"), "blocked", "flags")
    annual = gated.filter("fiscal_period = 'FY'").repartition("company_id")
    winners = annual.groupBy("company_id", "framework", "fiscal_year", "metric_id").agg(
        F.max_by(cell, F.struct(F.col("provenance") == "derived", "period_end", F.coalesce("period_start", "period_end"))).alias("cell")
    )
    years = winners.groupBy("company_id", "framework", "fiscal_year").agg(F.map_from_entries(F.collect_list(F.struct("metric_id", "cell"))).alias("m"))
    return years.withColumn("pm", _last_year("m"))


def _last_year(column: str) -> Column:
    by_year = Window.partitionBy("company_id").orderBy("fiscal_year")
    before = F.lag(F.struct("fiscal_year", column)).over(by_year)
    return F.when(before["fiscal_year"] == F.col("fiscal_year") - 1, before[column])


# ---- terms ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    """A value on its way through a formula: the columns that must travel with it, or the reason it is refused."""

    value: Column
    reason: Column
    facts: Column
    values: Column
    flags: Column
    derived: Column
    currencies: Column


def _empty() -> Column:
    return F.array().cast(NO_IDS)


def _merge(arrays: list[Column]) -> Column:
    return F.array_distinct(F.concat(*arrays)) if len(arrays) > 1 else arrays[0]


def combine(terms: list[Term], value: Column, reason: Column) -> Term:
    return Term(
        value, reason, _merge([t.facts for t in terms]), _merge([t.values for t in terms]), _merge([t.flags for t in terms]),
        reduce(lambda a, b: a | b, [t.derived for t in terms]), _merge([t.currencies for t in terms]),
    )


def _fact(cell: Column, missing: str) -> Term:
    failed = F.when(cell.isNull(), F.lit(missing)).when(cell["blocked"].isNotNull(), F.concat(F.lit("input_failed_quality:"), cell["blocked"]))
    return Term(
        cell["value"], failed, F.array(cell["fact_id"]), _empty(), F.coalesce(cell["flags"], _empty()),
        F.coalesce(cell["derived"], F.lit(False)), F.array_compact(F.array(cell["currency"])),
    )


class _Year:
    """Builds terms for one framework out of the columns m, pm (facts) and v, pv (analytics so far)."""

    def __init__(self, framework: Framework):
        self.framework = framework

    def _point(self, name: str, facts: str, values: str) -> Term:
        if name in self.framework.analytics:
            v = F.col(values)[name]
            reason = F.when(v.isNull(), F.lit(f"input_not_computed:{name}"))
            return Term(
                v["value"], reason, _empty(), F.array(v["value_id"]), F.coalesce(v["flags"], _empty()), F.coalesce(v["derived"], F.lit(False)),
                F.array_compact(F.array(v["currency"])),
            )
        return _fact(F.col(facts)[name], f"input_missing:{name}")

    def now(self, name: str) -> Term:
        return self._point(name, "m", "v")

    def before(self, name: str) -> Term:
        return self._point(name, "pm", "pv")

    def balance(self, name: str, basis: str) -> Term:
        """A denominator balance: closing, opening, or the mean of both (which needs closing first)."""
        metric = self.framework.metrics.get(name)
        if basis == "period_end" or metric is None or metric.period_type != "instant":
            return self.now(name)
        opening = _fact(F.col("pm")[name], f"opening_balance_missing:{name}")
        if basis == "opening":
            return opening
        closing = _fact(F.col("m")[name], f"input_missing:{name}")
        absent = F.when(F.col("m")[name].isNull(), F.lit(f"input_missing:{name}"))
        return combine([opening, closing], (opening.value + closing.value) / 2, F.coalesce(absent, opening.reason, closing.reason))

    def growth(self, name: str) -> Term:
        now, before = self.now(name), self.before(name)
        prior = F.when(before.reason.isNotNull(), F.lit(f"prior_year_missing:{name}"))
        refused = growth_refusal(before.value, now.value)
        reason = F.coalesce(now.reason, prior, F.when(refused.isNotNull(), F.concat(refused, F.lit(f":{name}"))))
        return combine([now, before], F.when(reason.isNull(), now.value / before.value - 1), reason)

    def sum_of(self, text: str, terms: dict[str, Term]) -> tuple[Column, list[Column]]:
        return formula(text).column(lambda n: terms[n].value), [terms[n].reason for n in formula(text).names]

    def event(self, a: Analytic) -> Column:
        basis, text = "period_end", a.metric
        if a.kind == "level":
            term = self.now(a.metric)
        elif a.kind == "growth":
            term, basis, text = self.growth(a.metric), "year_on_year", f"{a.metric}[t] / {a.metric}[t-1] - 1"
        elif a.kind == "elasticity":
            of, rel = self.growth(a.of), self.growth(a.relative_to)
            flat = F.when(rel.value == 0, F.lit(f"reference_growth_zero:{a.relative_to}"))
            reason = F.coalesce(of.reason, rel.reason, flat)
            term = combine([of, rel], F.when(reason.isNull(), of.value / rel.value), reason)
            basis, text = "year_on_year", f"growth({a.of}) / growth({a.relative_to})"
        elif a.kind == "expression":
            terms = {n: self.now(n) for n in formula(a.formula).names}
            value, reasons = self.sum_of(a.formula, terms)
            term = combine(list(terms.values()), value, F.coalesce(*reasons, F.when(value.isNull(), "division_by_zero")))
            text = a.formula
        else:
            top = {n: self.now(n) for n in formula(a.numerator).names}
            bottom = {n: self.balance(n, a.basis) for n in formula(a.denominator).names}
            upper, upper_reasons = self.sum_of(a.numerator, top)
            lower, lower_reasons = self.sum_of(a.denominator, bottom)
            broken = F.when(lower.isNull() | upper.isNull(), "division_by_zero").when(lower <= 0, "denominator_not_positive")
            reason = F.coalesce(*upper_reasons, *lower_reasons, broken)
            term = combine([*top.values(), *bottom.values()], F.when(reason.isNull(), upper / lower), reason)
            basis = a.basis
            text = f"({a.numerator}) / " + (a.denominator if basis == "period_end" else f"{basis}({a.denominator})")
        money = a.unit_kind in ("currency", "currency_per_share")
        count = F.size(term.currencies)
        of_currency = F.when(count > 1, "mixed_currency")
        if money:
            of_currency = of_currency.when(count == 0, "no_currency_input")
        reason = F.coalesce(term.reason, of_currency)
        inputs = F.concat(term.facts, term.values)
        candidates = [F.col("v" if n in self.framework.analytics else "m")[n].isNotNull() for n in sorted(a.references)]
        return F.when(
            reduce(lambda x, y: x | y, candidates),
            F.struct(
                F.lit(a.id).alias("analytic_id"), reason.alias("reason"), F.when(reason.isNull(), term.value).alias("value"),
                (F.try_element_at(term.currencies, F.lit(1)) if money else F.lit(None).cast("string")).alias("currency"),
                F.lit(text).alias("formula"), F.lit(basis).alias("basis"), term.facts.alias("input_fact_ids"), term.values.alias("input_value_ids"),
                F.array_sort(term.flags).alias("quality_flags"), term.derived.alias("uses_derived"),
                ids.analytic_id(F.col("company_id"), a.id, F.col("fiscal_year"), inputs).alias("value_id"),
            ),
        )


_VALUE_MAP = "map<string,struct<value_id:string,value:double,currency:string,flags:array<string>,derived:boolean>>"


def analytic_events(frame: DataFrame, frameworks: dict[str, Framework], only: list[str] | None = None) -> DataFrame:
    """One row per (company, analytic, year in which any input exists): a value, or the reason there is none."""
    found = []
    for framework in frameworks.values():
        wanted = framework.analytics if only is None else _with_inputs(framework, only)
        if not wanted:
            continue
        build = _Year(framework)
        layers = ordered_layers({a.id: a.references for a in wanted.values()})
        rows = frame.filter(F.col("framework") == framework.name).withColumn("v", F.create_map().cast(_VALUE_MAP))
        if any(n in framework.analytics for a in wanted.values() if a.kind in ("growth", "elasticity") for n in a.references):
            with_history = True
        else:
            with_history = False
            rows = rows.withColumn("pv", F.create_map().cast(_VALUE_MAP))
        for depth, layer in enumerate(layers):
            if with_history:
                rows = rows.withColumn("pv", _last_year("v"))
            rows = rows.withColumn(f"_l{depth}", F.array_compact(F.array(*[build.event(wanted[a]) for a in layer])))
            if depth + 1 < len(layers):
                done = F.filter(f"_l{depth}", lambda e: e["reason"].isNull())
                entry = lambda e: F.struct(e["analytic_id"], F.struct(
                    e["value_id"].alias("value_id"), e["value"].alias("value"), e["currency"].alias("currency"),
                    e["quality_flags"].alias("flags"), e["uses_derived"].alias("derived")))
                rows = rows.withColumn("v", F.map_concat("v", F.map_from_entries(F.transform(done, entry))))
        events = F.flatten(F.array(*[F.col(f"_l{d}") for d in range(len(layers))]))
        found.append(rows.select("company_id", "framework", "fiscal_year", F.explode(events).alias("e")).select("company_id", "framework", "fiscal_year", "e.*"))
    every = reduce(DataFrame.unionByName, found)
    # The first candidate year has no prior year by construction; that refusal is labelled as what it is.
    first = F.min("fiscal_year").over(Window.partitionBy("company_id", "analytic_id"))
    needs_history = F.col("reason").rlike("^(prior_year_missing|opening_balance_missing):")
    relabelled = F.when(
        needs_history & (F.col("fiscal_year") == F.col("first_year")), F.concat(F.lit("start_of_history:"), F.substring_index("reason", ":", -1))
    ).otherwise(F.col("reason"))
    return every.withColumn("first_year", first).withColumn("reason", relabelled).drop("first_year")


def _with_inputs(framework: Framework, only: list[str]) -> dict[str, Analytic]:
    """The named analytics and the ones they are built on, in framework order."""
    needed, queue = set(), [a for a in only if a in framework.analytics]
    while queue:
        current = queue.pop()
        if current not in needed:
            needed.add(current)
            queue += [n for n in framework.analytics[current].references if n in framework.analytics]
    return {aid: a for aid, a in framework.analytics.items() if aid in needed}


def analytic_values(events: DataFrame) -> DataFrame:
    return events.filter("reason IS NULL").drop("reason")


def not_computed(events: DataFrame) -> DataFrame:
    return events.filter("reason IS NOT NULL").groupBy("company_id", "analytic_id", "reason").agg(F.count("*").alias("n"))


def run_analytics(facts: DataFrame, issues: DataFrame, frameworks: dict[str, Framework], only: list[str] | None = None) -> DataFrame:
    return analytic_events(annual_frame(gate(facts, issues)), frameworks, only)


def series_currency(values: DataFrame) -> DataFrame:
    return values.groupBy("company_id", "analytic_id").agg(F.first("currency", ignorenulls=True).alias("currency"))


def fiscal_years(facts: DataFrame) -> DataFrame:
    return facts.filter("fiscal_period = 'FY'").groupBy("company_id").agg(F.array_sort(F.collect_set("fiscal_year")).alias("fiscal_years"))
