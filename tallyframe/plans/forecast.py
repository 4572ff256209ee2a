"""Forecasts: seed assumptions from history, resolve the assumption ladder, project every scenario.

One row per company and scenario carries its base-year values and its resolved assumptions as maps, both bounded by
the framework and the horizon. The years are folded over each row, one layer of metrics at a time, so a projection of
any number of companies is one pass without a shuffle after the maps are built.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.arrays import named
from ..functions.formula import formula
from ..operators.analytics import growth_refusal
from ..schemas import ASSUMPTIONS
from ..session import stage
from ..sources.specs import Framework
from .projection import Plan, Rule, all_plans, key_table, signature_column

BASE = "base"
SEED_WINDOW = 3
# Fixed order of the ladder, highest first; the last two share a rung.
LADDER = {"scenario": 0, "analyst_assumption": 1, "management_guidance": 2, "consensus": 3, "historical": 4, "derived": 4}


# ---- base year and seeds ----------------------------------------------------------------------------------------


def annual_points(facts: DataFrame) -> DataFrame:
    """One value per (company, metric, fiscal year) with the company's base year (its latest fiscal year)."""
    cell = F.struct("fact_id", F.col("value_f").alias("value"), "currency")
    annual = facts.filter("fiscal_period = 'FY'").repartition("company_id")
    points = annual.groupBy("company_id", "framework", "metric_id", "fiscal_year").agg(
        F.max_by(cell, F.struct(F.col("provenance") == "derived", "period_end", F.coalesce("period_start", "period_end"))).alias("c")
    )
    return points.select(
        "company_id", "framework", "metric_id", "fiscal_year", "c.*", F.max("fiscal_year").over(Window.partitionBy("company_id")).alias("base_year")
    )


def base_frame(points: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    """One row per company: base year, base facts as a map, and which plan applies."""
    now = F.col("fiscal_year") == F.col("base_year")
    cell = F.struct("fact_id", "value", "currency")
    frame = points.filter(now).groupBy("company_id", "framework", "base_year").agg(
        F.map_from_entries(F.collect_list(F.struct("metric_id", cell))).alias("base")
    )
    return frame.withColumn("signature", signature_column(frameworks, F.col("framework"), F.map_keys("base")))


def _median(values: Column) -> Column:
    """Median of at most a window's worth of values."""
    v, n = F.array_sort(values), F.size(values)
    middle = lambda i: F.get(v, i.cast("int"))
    return F.when(n % 2 == 1, middle(F.floor(n / 2))).otherwise((middle(n / 2 - 1) + middle(n / 2)) / 2)


def _span(first: Column, last: Column) -> Column:
    text = lambda y: F.concat(F.lit("FY"), y.cast("string"))
    return F.when(first == last, text(first)).otherwise(F.concat(text(first), F.lit("-"), text(last)))


def _recent(points: DataFrame, name: str) -> DataFrame:
    """Per (company, series): the values of the seed window and the year before it, by year."""
    entry = F.struct("fiscal_year", F.struct("value", "fact_ids"))
    near = F.col("fiscal_year").between(F.col("base_year") - SEED_WINDOW, F.col("base_year"))
    return points.groupBy("company_id", "base_year", F.col(name).alias("name")).agg(F.map_from_entries(F.collect_list(F.when(near, entry))).alias("at"))


def _seed_rows(recent: DataFrame, space: str) -> DataFrame:
    offsets = range(SEED_WINDOW - 1, -1, -1)
    years = [F.col("base_year") - o for o in offsets]
    if space == "growth":
        steps = []
        for y in years:
            now, before = F.col("at")[y], F.col("at")[y - 1]
            usable = now.isNotNull() & growth_refusal(before["value"], now["value"]).isNull()
            steps.append(F.when(usable, F.struct(y.alias("y"), (now["value"] / before["value"] - 1).alias("v"), F.concat(now["fact_ids"], before["fact_ids"]).alias("ids"))))
    else:
        steps = [F.when(F.col("at")[y].isNotNull(), F.struct(y.alias("y"), F.col("at")[y]["value"].alias("v"), F.col("at")[y]["fact_ids"].alias("ids"))) for y in years]
    used = recent.withColumn("used", F.array_compact(F.array(*steps)))
    first, last = F.get("used", F.lit(0))["y"], F.try_element_at("used", F.lit(-1))["y"]
    what = {"growth": "Median year-on-year growth of ", "level": "Median level of ", "rate": "Median "}[space]
    note = F.concat(F.lit(what), "name", F.lit(" over "), _span(first, last), F.lit(" ("), F.size("used").cast("string"), F.lit(" observations)"))
    return used.select(
        "company_id", "name", F.lit(space).alias("space"), F.size("used").alias("observations"),
        F.when(F.size("used") > 0, _median(F.transform("used", lambda u: u["v"]))).alias("value"),
        F.array_distinct(F.flatten(F.transform("used", lambda u: u["ids"]))).alias("source_fact_ids"), note.alias("description"),
    )


def seed_candidates(points: DataFrame, rates: DataFrame | None = None, wanted: dict[str, set[str]] | None = None) -> DataFrame:
    """Growth and level seeds of every metric and level seeds of every analytic, from the three years ending at the
    base year. rates: (company_id, analytic_id, fiscal_year, value, fact_ids) with the base year of the company.
    wanted: names by space, for who reads no others."""
    asked = lambda df, name, space: df if wanted is None else df.filter(F.col(name).isin(*sorted(wanted.get(space, ()))))
    metric_points = points.select("company_id", "base_year", "metric_id", "fiscal_year", "value", F.array("fact_id").alias("fact_ids"))
    growth, level = (_seed_rows(_recent(asked(metric_points, "metric_id", space), "metric_id"), space) for space in ("growth", "level"))
    seeds = growth.unionByName(level)
    return seeds if rates is None else seeds.unionByName(_seed_rows(_recent(asked(rates, "analytic_id", "rate"), "analytic_id"), "rate"))


def seeded_assumptions(frame: DataFrame, seeds: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(historical assumptions, reasons for the keys that could not be seeded) for the keys each company's plan needs."""
    wanted = frame.select("company_id", "signature", "base_year").join(keys, "signature")
    tried = wanted.join(seeds, ["company_id", "space", "name"], "left")
    text = lambda c: F.lit(None).cast("string").alias(c)
    has_facts = F.size(F.coalesce("source_fact_ids", F.array().cast("array<string>"))) > 0
    made = tried.filter(F.col("value").isNotNull() & has_facts).select(
        "company_id", "key", "value", F.lit("ratio").alias("unit"), text("period"), F.lit("historical").alias("type"), text("scenario"), "description",
        text("rationale"), text("source_document_id"), "source_fact_ids",
    )
    window = F.concat(F.lit("FY"), (F.col("base_year") - SEED_WINDOW + 1).cast("string"), F.lit("-FY"), F.col("base_year").cast("string"))
    unknown = F.col("observations").isNull()
    why = (
        F.when(F.col("space") == "rate", F.when(unknown, F.concat(F.lit("analytic was not computed in the historical analysis: "), "name"))
               .otherwise(F.concat(F.lit("no traceable values in "), window, F.lit(": "), "name")))
        .when(unknown, F.concat(F.lit("no annual history: "), "name"))
        .when(F.col("space") == "growth", F.concat(F.lit("no usable year-on-year observation in "), window, F.lit(": "), "name"))
        .otherwise(F.concat(F.lit("no annual observations in "), window, F.lit(": "), "name"))
    )
    unseeded = tried.filter(F.col("value").isNull() | ~has_facts).select("company_id", "key", why.alias("reason"))
    return made, unseeded


# ---- the ladder -------------------------------------------------------------------------------------------------


def resolve_assumptions(demands: DataFrame, assumptions: DataFrame) -> DataFrame:
    """demands (company_id, scenario, key, fiscal_year) with the winning assumption, or the reason there is none.

    Higher rungs win; inside a rung an assumption pinned to the year beats one for all years; an assumption that was
    declared without a value still wins its rung and then refuses.
    """
    rung = F.create_map(*[F.lit(x) for pair in LADDER.items() for x in pair])[F.col("type")]
    document = F.coalesce("source_document_id", F.lit(""))
    # Both sides are one row a company and key before they meet, so what applies is picked inside a row and the pairs are never sorted.
    declared = assumptions.groupBy("company_id", "key").agg(F.collect_list(F.struct(
        F.struct(rung.alias("rung"), F.col("period").isNull().alias("floating"), (F.col("type") == "derived").alias("derived"), document.alias("document")).alias("order"),
        F.col("value").alias("a_value"), F.col("type").alias("a_type"), F.col("period").alias("a_period"), F.col("scenario").alias("a_scenario"))).alias("declared"))
    asked = demands.groupBy("company_id", "key").agg(F.collect_set(F.struct("scenario", "fiscal_year")).alias("asked"))
    each = asked.join(declared, ["company_id", "key"], "left").select("company_id", "key", "declared", F.explode("asked").alias("d")).select("company_id", "d.scenario", "key", "d.fiscal_year", "declared")

    def applies(a: Column) -> Column:
        ours = (a["a_type"] != "scenario") | (a["a_scenario"] == F.col("scenario"))
        return ours & (a["a_period"].isNull() | (a["a_period"] == F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"))))

    ranked = F.transform(F.filter("declared", applies), lambda a: named(order=a["order"], a_value=a["a_value"], a_type=a["a_type"], pinned=a["a_period"].isNotNull()))
    best = each.select("company_id", "scenario", "key", "fiscal_year", F.array_min(ranked).alias("best"))
    reason = F.when(F.col("best").isNull(), F.concat(F.lit("assumption_missing:"), "key")).when(
        F.col("best.a_value").isNull(), F.concat(F.lit("assumption_unset:"), "key")
    )
    return best.select(
        "company_id", "scenario", "key", "fiscal_year", F.col("best.a_value").alias("value"), F.col("best.a_type").alias("type"),
        F.col("best.pinned").alias("pinned"), reason.alias("reason"),
    )


# ---- projection -------------------------------------------------------------------------------------------------


def _event(plan: Plan, rule: Rule, offset: Column, cur: Column, prev: Column) -> Column:
    """One attempted value `offset` years after the base year, from this year's values so far and last year's."""
    year = F.col("base_year") + offset
    spec = plan.framework.metrics[rule.metric]
    resolved = [F.col("asm")[F.concat(F.lit(f"{k}|"), year.cast("string"))] for k in rule.keys]
    # A key nobody demanded is missing as well.
    unresolved = [F.when(r.isNull(), F.lit(f"assumption_missing:{k}")).otherwise(r["reason"]) for k, r in zip(rule.keys, resolved, strict=True)]
    if rule.method == "growth":
        prior = prev[rule.metric]
        absent = F.when(offset == 1, f"base_year_actual_missing:{rule.metric}").otherwise(f"prior_year_not_projected:{rule.metric}")
        reason = F.coalesce(
            F.when(prior.isNull(), absent), F.when(prior["value"] <= 0, F.lit(f"growth_base_not_positive:{rule.metric}")), *unresolved
        )
        value, inputs = prior["value"] * (F.lit(1.0) + resolved[0]["value"]), [prior]
    elif rule.method == "level":
        reason, value, inputs = F.coalesce(*unresolved), resolved[0]["value"], []
    else:
        inputs = [cur[n] for n in rule.inputs]
        rates = {k.split(".", 1)[1]: r["value"] for k, r in zip(rule.keys, resolved, strict=True)}
        value = formula(rule.formula).column(lambda n: rates[n] if n in rates else cur[n]["value"])
        absent = [F.when(c.isNull(), F.lit(f"input_not_projected:{n}")) for n, c in zip(rule.inputs, inputs, strict=True)]
        reason = F.coalesce(*absent, *unresolved, F.when(value.isNull(), "division_by_zero"))
    nothing = F.array().cast("array<string>")
    value_ids = F.array_distinct(F.array(*[c["value_id"] for c in inputs])) if inputs else nothing
    fact_ids = F.array_distinct(F.concat(*[F.coalesce(c["fact_ids"], nothing) for c in inputs])) if inputs else nothing
    marks = [F.coalesce(c["fallback_for"], nothing) for c in inputs] + ([F.array(F.lit(rule.metric))] if rule.fallback else [])
    fallback = F.array_sort(F.array_distinct(F.concat(*marks))) if marks else nothing
    keys = F.array(*[F.lit(k) for k in rule.keys]) if rule.keys else nothing
    types = F.array(*[r["type"] for r in resolved]) if resolved else nothing
    if spec.unit_kind in ("currency", "currency_per_share"):
        seen = F.array_distinct(F.array_compact(F.array(*[c["currency"] for c in inputs]))) if inputs else nothing
        currency = F.coalesce(F.col("base")[rule.metric]["currency"], F.when(F.size(seen) == 1, F.try_element_at(seen, F.lit(1))))
    else:
        currency = F.lit(None).cast("string")
    return F.struct(
        F.lit(rule.metric).alias("metric_id"), year.cast("int").alias("fiscal_year"), reason.alias("reason"), F.when(reason.isNull(), value).alias("value"),
        F.lit(spec.unit_kind).alias("unit_kind"), currency.alias("currency"), F.lit(rule.method).alias("method"), F.lit(rule.formula).alias("formula"),
        keys.alias("assumption_ids"), types.alias("assumption_types"), value_ids.alias("input_value_ids"), fact_ids.alias("input_fact_ids"),
        fallback.alias("fallback_for"),
        ids.forecast_id(F.col("company_id"), F.col("scenario"), rule.metric, year, F.concat(keys, value_ids)).alias("value_id"),
    )


def _actual(plan: Plan, rule: Rule) -> Column:
    cell, nothing = F.col("base")[rule.metric], F.array().cast("array<string>")
    own = F.array(cell["fact_id"])
    return F.when(cell.isNotNull(), F.struct(
        F.lit(rule.metric).alias("metric_id"), F.col("base_year").alias("fiscal_year"), F.lit(None).cast("string").alias("reason"), cell["value"].alias("value"),
        F.lit(plan.framework.metrics[rule.metric].unit_kind).alias("unit_kind"), cell["currency"].alias("currency"), F.lit("actual").alias("method"),
        F.lit("reported").alias("formula"), nothing.alias("assumption_ids"), nothing.alias("assumption_types"), nothing.alias("input_value_ids"),
        own.alias("input_fact_ids"), nothing.alias("fallback_for"),
        ids.forecast_id(F.col("company_id"), F.col("scenario"), rule.metric, F.col("base_year"), own).alias("value_id"),
    ))


def _as_map(events: Column) -> Column:
    """Projected values as a map for the next layer; only actuals carry their fact ids on."""
    done = F.filter(events, lambda e: e["reason"].isNull())
    own = lambda e: F.when(e["method"] == "actual", e["input_fact_ids"]).otherwise(F.array().cast("array<string>"))
    return F.map_from_entries(F.transform(done, lambda e: F.struct(e["metric_id"], F.struct(
        e["value"].alias("value"), e["currency"].alias("currency"), e["value_id"].alias("value_id"), own(e).alias("fact_ids"), e["fallback_for"].alias("fallback_for")))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _year(plan: Plan, state: Column, offset: Column) -> Column:
    """The state (cur: values by metric, events: all attempts) one year on. A value of last year is reachable only as such."""
    prev = state["cur"]

    def through(layers: list[list[str]], held: Column) -> Column:
        if not layers:
            return held
        attempts = F.array(*[_event(plan, plan.rules[m], offset, held["cur"], prev) for m in layers[0]])
        grown = lambda made: F.struct(F.map_concat(held["cur"], _as_map(made)).alias("cur"), F.concat(held["events"], made).alias("events"))
        return _let(attempts, lambda made: _let(grown(made), lambda further: through(layers[1:], further)))

    empty = F.struct(F.map_filter(prev, lambda k, v: F.lit(False)).alias("cur"), state["events"].alias("events"))
    return _let(empty, lambda held: through(plan.layers, held))


def project(frame: DataFrame, plans: list[Plan], years: int) -> DataFrame:
    """frame: one row per (company, scenario) with base_year, signature, base and asm. One row per attempted value.

    Years are a fold over the row, so the plan holds one year's expressions whatever the horizon.
    """
    found = []
    for plan in plans:
        rows = frame.filter(F.col("signature") == plan.signature)
        rows = rows.withColumn("_actual", F.array_compact(F.array(*[_actual(plan, r) for r in plan.rules.values()])))
        start = F.struct(_as_map(F.col("_actual")).alias("cur"), F.col("_actual").alias("events"))
        one_year = lambda state, offset: _year(plan, state, offset)  # noqa: B023, E731 - used at once
        events = F.aggregate(F.sequence(F.lit(1), F.lit(years)), start, one_year, lambda state: state["events"])
        found.append(rows.select("company_id", "framework", "scenario", "base_year", F.explode(events).alias("e")).select("company_id", "framework", "scenario", "base_year", "e.*"))
    return reduce(DataFrame.unionByName, found)


@dataclass
class Forecast:
    """A forecast run: values with their lineage, what was refused and why, and the assumptions behind it."""

    events: DataFrame
    assumptions: DataFrame
    unseeded: DataFrame
    plans: list[Plan]
    frame: DataFrame

    @property
    def values(self) -> DataFrame:
        return self.events.filter("reason IS NULL").drop("reason")

    @property
    def not_projected(self) -> DataFrame:
        """Refusals counted over the base scenario only."""
        return self.events.filter(F.col("reason").isNotNull() & (F.col("scenario") == BASE)).groupBy("company_id", "metric_id", "reason").agg(F.count("*").alias("n"))


def _seeding(facts: DataFrame, frameworks: dict[str, Framework], rates: DataFrame | None, plans: list[Plan]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row per company, seeded assumptions, keys without a seed); the rates are computed once for both."""
    points = stage(annual_points(facts), "annual")
    frame = base_frame(points, frameworks)
    if rates is not None:
        rates = stage(rates.join(points.select("company_id", "base_year").distinct(), "company_id"), "rates")
    wanted: dict[str, set[str]] = {}
    for space, name in {tuple(k.split(".", 1)) for p in plans for k in p.keys}:
        wanted.setdefault(space, set()).add(name)
    return frame, *seeded_assumptions(frame, seed_candidates(points, rates, wanted), key_table(facts.sparkSession, plans))


def unseeded(facts: DataFrame, frameworks: dict[str, Framework], *, rates: DataFrame | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """`Forecast.unseeded` of a run on the same facts and rates, without projecting anything."""
    return _seeding(facts, frameworks, rates, all_plans(frameworks, only))[2]


def run_forecast(
    facts: DataFrame, frameworks: dict[str, Framework], *, rates: DataFrame | None = None, analyst: DataFrame | None = None,
    scenarios: DataFrame | None = None, years: int = 5, only: tuple[str, ...] | None = None,
) -> Forecast:
    """facts: current and derived. rates: analytic values with the facts under them (see lineage.facts_under).
    analyst: authored assumptions. scenarios: (company_id, scenario) beyond the base case."""
    spark = facts.sparkSession
    plans = all_plans(frameworks, only)
    frame, seeds, missing = _seeding(facts, frameworks, rates, plans)
    everything = seeds if analyst is None else seeds.unionByName(analyst)
    everything = stage(everything.select(*[c.split(" ")[0] for c in ASSUMPTIONS.split(", ")]), "assumptions")

    names = frame.withColumn("scenario", F.lit(BASE))
    if scenarios is not None:
        extra = scenarios.filter(F.col("scenario") != BASE).select("company_id", "scenario").distinct()
        names = names.unionByName(frame.join(extra, "company_id").select(*names.columns))
    horizon = F.sequence(F.col("base_year") + 1, F.col("base_year") + years)
    demands = names.join(key_table(spark, plans), "signature").select("company_id", "scenario", "key", F.explode(horizon).alias("fiscal_year"))
    resolved = resolve_assumptions(demands, everything)
    slot = F.concat_ws("|", "key", F.col("fiscal_year").cast("string"))
    by_scenario = resolved.groupBy("company_id", "scenario").agg(
        F.map_from_entries(F.collect_list(F.struct(slot, F.struct("value", "type", "reason")))).alias("asm")
    )
    ready = stage(names.join(by_scenario, ["company_id", "scenario"], "left").withColumn(
        "asm", F.coalesce("asm", F.create_map().cast("map<string,struct<value:double,type:string,reason:string>>"))), "scenarios")
    # A row is small but dear to project, so rows are dealt over all cores however few files they fill.
    spread = max(spark.sparkContext.defaultParallelism, ready.rdd.getNumPartitions())
    return Forecast(project(ready.repartition(spread, "company_id", "scenario"), plans, years), everything, missing, plans, ready)
