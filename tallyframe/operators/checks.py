"""Accounting identities and continuity of annual series: outcomes, issues, coverage."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.formula import formula
from ..functions.numeric import rounding_tolerance
from ..schemas import MONEY
from ..session import stage
from ..sources.specs import OPENING, Check, Framework, metric_spec
from . import derive

# Fixed values. An opening balance may be dated up to eight days before the period; a unit error is a power of a
# thousand within 0.2 in log10; an outlier has a modified z-score above 3.5 over at least five changes.
OPENING_LOOKBACK_DAYS = 8
SCALE_POWERS = (3, 6, 9)
SCALE_BAND = 0.2
OUTLIER_CUTOFF = 3.5
OUTLIER_FACTOR = 0.6745
MIN_CHANGES = 5
SEVERITIES = ("error", "warning", "info")


def _no_details() -> Column:
    return F.create_map().cast("map<string,string>")


# ---- identities -------------------------------------------------------------------------------------------------


def opening_balances(flows: DataFrame, balances: DataFrame, metrics: list[str]) -> DataFrame:
    """For every period start, the latest balance of each metric dated one to eight days before it.

    The range becomes eight candidate dates, so the as-of lookup is an ordinary hash join on (company, date).
    """
    starts = flows.select("company_id", "period_start").distinct()
    dated = starts.withColumn("period_end", F.explode(F.transform(F.sequence(F.lit(1), F.lit(OPENING_LOOKBACK_DAYS)), lambda d: F.date_sub(F.col("period_start"), d))))
    near = dated.join(balances.select("company_id", "period_end", "m"), ["company_id", "period_end"])
    picks = [F.max_by(F.col("m")[name], F.when(F.col("m")[name].isNotNull(), F.col("period_end"))).alias(name) for name in metrics]
    found = near.groupBy("company_id", "period_start").agg(*picks)
    entries = F.filter(F.array(*[F.struct(F.lit(n + OPENING), F.col(n).alias("cell")) for n in metrics]), lambda e: e["cell"].isNotNull())
    return found.select("company_id", "period_start", F.map_from_entries(entries).alias("opening"))


def _identity_event(check: Check, flow_metrics: set[str]) -> Column:
    anchored_on = [n for n in check.names if n in flow_metrics] or [n for n in check.names if not n.endswith(OPENING)]
    cells = {n: F.col("m")[n] for n in check.names}
    value = lambda n: F.coalesce(cells[n]["value"], F.lit(0).cast(MONEY)) if n in check.optional else cells[n]["value"]
    left, right = (formula(side).column(value).cast(MONEY) for side in (check.left, check.right))
    used = F.filter(F.array(*cells.values()), lambda c: c.isNotNull())
    tolerance = rounding_tolerance(F.transform(used, lambda c: c["value"]))
    required = [cells[n].isNotNull() for n in check.names if n not in check.optional]
    anchored = reduce(lambda a, b: a | b, [cells[n].isNotNull() for n in anchored_on])
    complete = reduce(lambda a, b: a & b, required)
    outcome = F.when(~complete, "not_evaluable").when(F.abs(left - right) <= tolerance, "passed").otherwise("failed")
    omitted = F.array_join(F.array_compact(F.array(*[F.when(cells[n].isNull(), F.lit(n)) for n in check.optional])), ",") if check.optional else F.lit("")
    return F.when(
        anchored,
        F.struct(
            F.lit(check.id).alias("check_id"), F.lit(check.severity).alias("severity"), outcome.alias("outcome"), left.alias("left"),
            right.alias("right"), tolerance.alias("tolerance"), F.transform(used, lambda c: c["fact_id"]).alias("fact_ids"), omitted.alias("omitted"),
            F.array_join(F.transform(F.filter(used, lambda c: c["derived"]), lambda c: c["fact_id"]), ",").alias("derived_inputs"),
        ),
    )


def identity_events(facts: DataFrame, frameworks: dict[str, Framework], only: tuple[str, ...] | None = None) -> DataFrame:
    """One row per (company, check, anchor period): both sides, the rounding tolerance and the outcome. `only` names the
    checks to make, all by default.

    Anchors are gathered once; flows, balances and opening balances all read the written rows.
    """
    everything = stage(derive.anchor_frame(facts, ["company_id", "framework", "period_type", "period_start", "period_end"]), "anchors")
    found = []
    for framework in frameworks.values():
        flow_metrics = {m.id for m in framework.metrics.values() if m.period_type == "duration"}
        over_flows, over_balances = [], []
        for check in (c for c in framework.checks.values() if only is None or c.id in only):
            is_flow = any(n in flow_metrics or n.endswith(OPENING) for n in check.names)
            (over_flows if is_flow else over_balances).append(check)
        frame = everything.filter(F.col("framework") == framework.name)
        flows, balances = frame.filter("period_type = 'duration'"), frame.filter("period_type = 'instant'")
        if over_flows:
            opened = sorted({n.removesuffix(OPENING) for c in over_flows for n in c.names if n.endswith(OPENING)})
            closing = balances.select("company_id", "period_end", F.col("m").alias("closing"))
            joined = flows.join(closing, ["company_id", "period_end"], "left")
            parts = [F.col("m"), F.coalesce("closing", F.map_filter("m", lambda k, v: F.lit(False)))]
            if opened:
                joined = joined.join(opening_balances(flows, balances, opened), ["company_id", "period_start"], "left")
                parts.append(F.coalesce("opening", F.map_filter("m", lambda k, v: F.lit(False))))
            found.append((joined.withColumn("m", F.map_concat(*parts)), over_flows, flow_metrics))
        if over_balances:
            found.append((balances, over_balances, flow_metrics))
    parts = [
        df.select(
            "company_id", "framework", "period_type", "period_start", "period_end", "fiscal_year", "fiscal_period",
            F.explode(F.array_compact(F.array(*[_identity_event(c, flow_metrics) for c in checks]))).alias("e"),
        )
        for df, checks, flow_metrics in found
    ]
    every = reduce(DataFrame.unionByName, parts)
    return every.select("company_id", "framework", "period_type", "period_start", "period_end", "fiscal_year", "fiscal_period", "e.*")


def identity_issues(events: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return events.filter("outcome = 'failed'").select(
        "company_id", "check_id", "severity", F.lit(None).cast("string").alias("metric_id"),
        calendar.period_label(F.col("fiscal_year"), F.col("fiscal_period")).alias("period"), "fact_ids",
        F.create_map(
            F.lit("left"), text("left"), F.lit("right"), text("right"),
            F.lit("difference"), (F.col("left") - F.col("right")).cast(MONEY).cast("string"), F.lit("tolerance"), text("tolerance"),
            F.lit("optional_terms_assumed_zero"), F.col("omitted"), F.lit("derived_inputs"), F.col("derived_inputs"),
        ).alias("details"),
    )


# ---- continuity -------------------------------------------------------------------------------------------------


def sign_events(facts: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    specs = metric_spec(facts.sparkSession, frameworks).filter("sign = 'non_negative'").select("framework", "metric_id")
    return facts.join(specs, ["framework", "metric_id"]).select(
        "company_id", "framework", "metric_id", "fact_id", "value", "fiscal_year", "fiscal_period", "provenance", "formula",
        F.when(F.col("value") < 0, "failed").otherwise("passed").alias("outcome"),
    )


def annual_series(facts: DataFrame) -> DataFrame:
    return facts.filter("fiscal_period = 'FY'")


def missing_years(facts: DataFrame) -> DataFrame:
    """Per annual series of two values or more: the fiscal years absent strictly inside its own span."""
    spans = annual_series(facts).groupBy("company_id", "framework", "metric_id").agg(
        F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"), F.count("*").alias("n"),
        F.collect_set("fiscal_year").alias("years"),
    )
    absent = F.array_sort(F.array_except(F.sequence("first_year", "last_year"), "years"))
    return spans.filter("n >= 2").select(
        "company_id", "framework", "metric_id", "first_year", "last_year", absent.alias("missing"),
        F.when(F.size(absent) > 0, "failed").otherwise("passed").alias("outcome"),
    )


def annual_changes(facts: DataFrame) -> DataFrame:
    """Consecutive-year pairs with the scale verdict and, where it has a meaning, the log change."""
    series = Window.partitionBy("company_id", "framework", "metric_id").orderBy("fiscal_year", "period_end")
    rows = annual_series(facts).select(
        "company_id", "framework", "metric_id", "fiscal_year", "period_end", "value_f", "fact_id",
        F.lag(F.struct("fiscal_year", "value_f", "fact_id")).over(series).alias("prev"),
        F.count("*").over(Window.partitionBy("company_id", "framework", "metric_id")).alias("points"),
    )
    consecutive = F.col("prev.fiscal_year") == F.col("fiscal_year") - 1
    usable = F.col("value_f") * F.signum("prev.value_f") > 0
    ratio = F.abs(F.col("value_f") / F.when(F.col("prev.value_f") != 0, F.col("prev.value_f")))
    distance = [F.abs(F.abs(F.log10("ratio")) - F.lit(float(p))) <= SCALE_BAND for p in SCALE_POWERS]
    return (
        rows.withColumn("consecutive", F.coalesce(consecutive, F.lit(False)))
        .withColumn("ratio", F.when(F.col("consecutive") & usable, ratio))
        .select(
            "company_id", "framework", "metric_id", "fiscal_year", "points", "consecutive", "fact_id", F.col("prev.fact_id").alias("prev_fact_id"),
            F.when(
                F.col("consecutive"),
                F.when(F.col("ratio").isNull(), "not_evaluable").when(distance[0] | distance[1] | distance[2], "failed").otherwise("passed"),
            ).alias("scale_outcome"),
            F.log10("ratio").alias("log10_ratio"), F.log("ratio").alias("log_change"),
        )
        .filter("points >= 2")
    )


def unusual_changes(changes: DataFrame) -> DataFrame:
    """Modified z-score of every log change against its own series; one not_evaluable row for a series too short
    or without spread."""
    keys = ["company_id", "framework", "metric_id"]
    series = Window.partitionBy(*keys)
    scored = (
        changes.withColumn("n", F.count("log_change").over(series))
        .withColumn("middle", F.median("log_change").over(series))
        .withColumn("mad", F.median(F.abs(F.col("log_change") - F.col("middle"))).over(series))
        .withColumn("evaluable", (F.col("n") >= MIN_CHANGES) & (F.col("mad") != 0))
        .withColumn("at", F.row_number().over(series.orderBy("fiscal_year")))
        .filter(F.when(F.coalesce("evaluable", F.lit(False)), F.col("log_change").isNotNull()).otherwise(F.col("at") == 1))
    )
    z = F.when(F.col("evaluable"), F.lit(OUTLIER_FACTOR) * (F.col("log_change") - F.col("middle")) / F.col("mad"))
    return scored.select(
        *keys, F.when(F.col("evaluable"), F.col("fiscal_year")).alias("fiscal_year"), "fact_id", "prev_fact_id", "n", "log_change", z.alias("modified_z"),
        F.when(z.isNull(), "not_evaluable").when(F.abs(z) > OUTLIER_CUTOFF, "failed").otherwise("passed").alias("outcome"),
    )


def coverage_cells(facts: DataFrame) -> DataFrame:
    """(company, metric, fiscal year, R or D): the annual coverage matrix in long form; later facts win a shared year."""
    flag = F.when(F.col("provenance") == "reported", "R").otherwise("D")
    return annual_series(facts).groupBy("company_id", "framework", "metric_id", "fiscal_year").agg(F.max_by(flag, F.struct("period_end", "period_start")).alias("cell"))


def short_histories(cells: DataFrame, historical_years: int) -> DataFrame:
    """One row per company: the metrics with some, but fewer than the configured number of, fiscal years."""
    per_metric = cells.groupBy("company_id", "metric_id").agg(F.count("*").alias("n")).filter(F.col("n") < historical_years)
    return per_metric.groupBy("company_id").agg(
        F.count("*").alias("n_metrics"), F.array_join(F.array_sort(F.collect_list("metric_id")), ", ").alias("metrics")
    )


# ---- issues and roll-ups ----------------------------------------------------------------------------------------


def _issue(df: DataFrame, check: str, severity: str, metric="metric_id", period=None, fact_ids=None, details=None) -> DataFrame:
    return df.select(
        "company_id", F.lit(check).alias("check_id"), F.lit(severity).alias("severity"),
        (F.col(metric) if metric else F.lit(None).cast("string")).alias("metric_id"),
        (F.lit(None).cast("string") if period is None else period).alias("period"),
        (F.array().cast("array<string>") if fact_ids is None else fact_ids).alias("fact_ids"),
        (_no_details() if details is None else F.create_map(*details).cast("map<string,string>")).alias("details"),
    )


def continuity_issues(sign: DataFrame, gaps: DataFrame, changes: DataFrame, unusual: DataFrame) -> DataFrame:
    annual = F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"))
    label = calendar.period_label(F.col("fiscal_year"), F.col("fiscal_period"))
    pair = F.array("prev_fact_id", "fact_id")
    negative = _issue(sign.filter("outcome = 'failed'"), "sign", "error", period=label, fact_ids=F.array("fact_id"),
                      details=[F.lit("value"), F.col("value").cast("string"), F.lit("provenance"), F.col("provenance"), F.lit("formula"), F.col("formula")])
    absent = _issue(gaps.filter("outcome = 'failed'"), "missing_years", "warning",
                    details=[F.lit("missing"), F.array_join(F.col("missing").cast("array<string>"), ",")])
    broken = _issue(changes.filter("scale_outcome = 'failed'"), "scale_break", "warning", period=annual, fact_ids=pair,
                    details=[F.lit("log10_ratio"), F.round("log10_ratio", 3).cast("string")])
    odd = _issue(unusual.filter("outcome = 'failed'"), "unusual_change", "info", period=annual, fact_ids=pair,
                 details=[F.lit("modified_z"), F.round("modified_z", 2).cast("string"), F.lit("observations"), F.col("n").cast("string"),
                          F.lit("change"), (F.exp("log_change") - 1).cast("string")])
    return negative.unionByName(absent).unionByName(broken).unionByName(odd)


def extraction_issues(restated: DataFrame, switches: DataFrame, mismatches: DataFrame) -> DataFrame:
    """What extraction already found, carried into the quality report."""
    # Versions are rows; a period restated in any unit is one issue. Counting first keeps the group small.
    told = F.concat_ws("|", F.col("value").cast("double").cast("string"), F.coalesce("form", F.lit("")), F.col("filed").cast("string"))
    kind = F.when(F.col("unit").contains("/"), "currency_per_share").when(F.col("unit").rlike("^[A-Z]{3}$"), "currency").when(F.lower("unit") == "pure", "ratio").otherwise("count")
    periods = restated.groupBy("company_id", "metric_id", "period_type", "period_end", "period").agg(
        F.max("version").alias("versions"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("version", told.alias("told")))), lambda v: v["told"]), ";").alias("told"), F.max_by(kind, "version").alias("kind"))
    a = _issue(periods, "restatement", "info", period=F.col("period"), details=[F.lit("versions"), F.col("versions").cast("string"), F.lit("values"), F.col("told"), F.lit("unit_kind"), F.col("kind")])
    b = _issue(switches, "concept_switch", "warning", details=[F.lit("concepts"), F.array_join("concepts", ", ")])
    c = _issue(mismatches, "currency", "warning", details=[F.lit("currency"), F.col("currency"), F.lit("count"), F.col("n").cast("string")])
    return a.unionByName(b).unionByName(c)


def history_issues(short: DataFrame, historical_years: int) -> DataFrame:
    return _issue(short, "history_length", "info", metric=None,
                  details=[F.lit("metrics"), F.col("metrics"), F.lit("configured_years"), F.lit(str(historical_years))])


def check_rollup(outcomes: DataFrame) -> DataFrame:
    """(company, check): passed, failed, not evaluable. Absence of data is never a pass."""
    return outcomes.groupBy("company_id", "check_id").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("passed", "failed", "not_evaluable")]
    )


def severity_counts(issues: DataFrame, companies: DataFrame) -> DataFrame:
    counted = issues.groupBy("company_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return companies.select("company_id").join(counted, "company_id", "left").fillna(0, list(SEVERITIES))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


@dataclass
class Quality:
    """Everything one quality run produces; each member is a lazy DataFrame over all companies."""

    current: DataFrame
    derived: DataFrame
    issues: DataFrame
    outcomes: DataFrame
    coverage: DataFrame
    derivations: DataFrame

    @property
    def all_facts(self) -> DataFrame:
        return self.current.unionByName(self.derived)


def run_quality(
    facts: DataFrame, frameworks: dict[str, Framework], *, historical_years: int = 10, extraction: DataFrame | None = None
) -> Quality:
    """Current view, derivations, checks. Reported values are never modified."""
    from .extract import current_facts

    current = stage(current_facts(facts), "current")
    interim = stage(derive.interim_events(current, frameworks), "interim")
    with_interim = current.unionByName(derive.interim_facts(interim))
    formulas = stage(derive.formula_events(with_interim, frameworks), "formulas")
    derived = derive.interim_facts(interim).unionByName(derive.formula_facts(formulas))
    everything = current.unionByName(derived)

    # Issues and outcomes both read these.
    identities = stage(identity_events(everything, frameworks), "identities")
    sign, gaps = sign_events(everything, frameworks), missing_years(everything)
    changes = stage(annual_changes(everything), "changes")
    unusual, cells = unusual_changes(changes), coverage_cells(everything)
    issues = [
        derive.formula_issues(formulas), identity_issues(identities), continuity_issues(sign, gaps, changes, unusual),
        history_issues(short_histories(cells, historical_years), historical_years),
    ] + ([extraction] if extraction is not None else [])
    named = lambda df, check, col="outcome": df.select("company_id", F.lit(check).alias("check_id"), F.col(col).alias("outcome"))
    outcomes = [
        derive.formula_outcomes(formulas), identities.select("company_id", "check_id", "outcome"), named(sign, "sign"),
        named(gaps, "missing_years"), named(changes.filter("consecutive"), "scale_break", "scale_outcome"), named(unusual, "unusual_change"),
    ]
    return Quality(
        current, derived, reduce(DataFrame.unionByName, issues), reduce(DataFrame.unionByName, outcomes), cells,
        derive.derivation_counts(current, interim, formulas, frameworks),
    )


def metrics_without_data(entities: DataFrame, disclosed: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    """(company_id, metric_id, reason): tagged metrics of a company's framework of which it has disclosed nothing. A
    finding of its own (`no_xbrl_data`), counted with the derivation outcomes; never a passed check."""
    wanted = metric_spec(entities.sparkSession, frameworks).filter("has_concepts").select("framework", "metric_id")
    expected = entities.select("company_id", "framework").join(wanted, "framework")
    return expected.join(disclosed.select("company_id", "metric_id").distinct(), ["company_id", "metric_id"], "left_anti").select("company_id", "metric_id", F.lit("no_xbrl_data").alias("reason"))
