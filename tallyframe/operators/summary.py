"""Descriptive statistics of annual series, and what a chart of them would show or hide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.specs import Framework, analytic_spec

MIN_TREND_POINTS = 5
MIN_STDEV_POINTS = 3


def _tail_mean(n: int) -> Column:
    """Mean of the last n values, only when they are n consecutive years."""
    tail = F.filter("points", lambda p: p["y"] > F.col("latest_year") - n)
    return F.when(F.size(tail) == n, F.aggregate(tail, F.lit(0.0), lambda a, p: a + p["v"]) / F.lit(float(n)))


def _cagr(first: Column, last: Column, span: Column) -> Column:
    safe = (span > 0) & (first > 0) & (last > 0)
    return F.when(safe, F.pow(F.when(safe, last / first), F.when(safe, F.lit(1.0) / span)) - 1)


def series_summary(values: DataFrame, frameworks: dict[str, Framework] | None = None) -> DataFrame:
    """One row per (company, analytic). A series holds one value per fiscal year, so the collected points are small."""
    if "kind" not in values.columns:
        spec = analytic_spec(values.sparkSession, frameworks).select("framework", "analytic_id", "kind", "unit_kind")
        values = values.join(spec, ["framework", "analytic_id"])
    year, value = F.col("fiscal_year"), F.col("value")
    stats = values.groupBy("company_id", "analytic_id", "kind", "unit_kind").agg(
        F.count("*").alias("observations"), F.min(year).alias("first_year"), F.max(year).alias("latest_year"),
        F.max_by(value, year).alias("latest"), F.median(value).alias("median"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(F.struct(value.alias("v"), year.alias("y"))).alias("low"), F.max(F.struct(value.alias("v"), (-year).alias("y"))).alias("high"),
        F.array_sort(F.collect_list(F.when(F.size("quality_flags") > 0, year))).alias("flagged_years"),
        F.array_sort(F.collect_list(F.when(F.col("uses_derived"), year))).alias("derived_years"),
        F.collect_list(F.struct(year.alias("y"), value.alias("v"))).alias("points"),
        F.regr_slope(value, year.cast("double")).alias("slope"), F.count_if(value < 0).alias("negatives"),
    )
    at = F.map_from_entries("points")
    compounds = F.col("unit_kind").isin("currency", "count") & F.col("kind").isin("level", "expression")
    full = _cagr(at[F.col("first_year")], F.col("latest"), (F.col("latest_year") - F.col("first_year")).cast("double"))
    recent = {n: _cagr(at[F.col("latest_year") - n], F.col("latest"), F.lit(float(n))) for n in (3, 5)}
    return stats.select(
        "company_id", "analytic_id", "observations", "first_year", "latest_year", "latest", "median", "mean",
        F.when(F.col("observations") >= MIN_STDEV_POINTS, F.col("sd")).alias("stdev"),
        F.col("low.v").alias("min_value"), F.col("low.y").alias("min_year"), F.col("high.v").alias("max_value"), (-F.col("high.y")).alias("max_year"),
        "flagged_years", "derived_years", _tail_mean(3).alias("avg_3y"), _tail_mean(5).alias("avg_5y"),
        F.when(F.col("observations") >= MIN_TREND_POINTS, F.col("slope")).alias("trend_per_year"),
        F.when(compounds, full).alias("cagr_full"), F.when(compounds, recent[3]).alias("cagr_3y"), F.when(compounds, recent[5]).alias("cagr_5y"),
        F.when(F.col("kind") == "growth", F.col("negatives")).alias("down_years"),
    )


def metric_series(facts: DataFrame) -> DataFrame:
    """Annual values of metrics as (company_id, series_id, fiscal_year, value, ...)."""
    return facts.filter("fiscal_period = 'FY'").select(
        "company_id", "framework", F.col("metric_id").alias("series_id"), "fiscal_year", F.col("value_f").alias("value"), "currency",
        F.col("fact_id").alias("lineage_id"),
    )


def max_drawdown(series: DataFrame) -> DataFrame:
    """Largest fall from a running peak of a positive annual series: (company, series, decline, peak year, trough year).

    A value equal to the peak is not a new peak, and of two equal falls the earlier one counts.
    """
    keys = ["company_id", "series_id"]
    so_far = Window.partitionBy(*keys).orderBy("fiscal_year").rowsBetween(Window.unboundedPreceding, 0)
    peaks = series.withColumn("peak", F.max(F.struct("value", (-F.col("fiscal_year")).alias("back"))).over(so_far))
    below = (-F.col("peak.back") != F.col("fiscal_year")) & (F.col("value") > 0)
    falls = F.when(below, F.struct((F.col("value") / F.col("peak.value") - 1).alias("decline"), F.col("fiscal_year").alias("y"), (-F.col("peak.back")).alias("p")))
    worst = peaks.groupBy(*keys).agg(F.min("value").alias("lowest"), F.count("*").alias("n"), F.min(falls).alias("worst"))
    return worst.filter("lowest > 0 AND n >= 2 AND worst IS NOT NULL").select(
        *keys, F.col("worst.decline").alias("decline"), F.col("worst.p").alias("peak_year"), F.col("worst.y").alias("trough_year")
    )


def growth_drawdowns(facts: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    """The drawdown under each growth analytic, keyed by the analytic."""
    spec = analytic_spec(facts.sparkSession, frameworks).filter("kind = 'growth'").select("framework", "analytic_id", F.col("metric").alias("series_id"))
    fallen = max_drawdown(metric_series(facts))
    owners = facts.select("company_id", "framework").distinct()
    return fallen.join(owners, "company_id").join(spec, ["framework", "series_id"]).select("company_id", "analytic_id", "decline", "peak_year", "trough_year")


# ---- islands, holes, truncation ---------------------------------------------------------------------------------


def year_islands(series: DataFrame) -> DataFrame:
    """Runs of consecutive fiscal years: (company, series, first year, last year, points)."""
    keys = ["company_id", "series_id"]
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("fiscal_year"))
    years = series.select(*keys, "fiscal_year").distinct()
    return years.withColumn("island", F.col("fiscal_year") - position).groupBy(*keys, "island").agg(
        F.min("fiscal_year").alias("from_year"), F.max("fiscal_year").alias("to_year"), F.count("*").alias("points")
    ).drop("island")


def range_text(spans: Column) -> Column:
    """array<struct<from_year,to_year>> in order -> 'FY2016–FY2018 and FY2021'."""
    one = lambda s: F.when(s["from_year"] == s["to_year"], F.concat(F.lit("FY"), s["from_year"].cast("string"))).otherwise(
        F.concat(F.lit("FY"), s["from_year"].cast("string"), F.lit("–FY"), s["to_year"].cast("string")))
    words = F.transform(spans, one)
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), ", ")
    return F.when(F.size(words) == 0, "").when(F.size(words) == 1, F.element_at(words, 1)).otherwise(F.concat(head, F.lit(" and "), F.try_element_at(words, F.lit(-1))))


def years_text(years: Column) -> Column:
    """array<int> of distinct years -> the same wording."""
    ordered = F.array_sort(years)
    start = F.array().cast("array<struct<from_year:int,to_year:int>>")

    def step(spans: Column, y: Column) -> Column:
        last = F.try_element_at(spans, F.lit(-1))
        extended = F.concat(F.slice(spans, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0))), F.array(F.struct(last["from_year"].alias("from_year"), y.alias("to_year"))))
        fresh = F.concat(spans, F.array(F.struct(y.alias("from_year"), y.alias("to_year"))))
        return F.when(last["to_year"] == y - 1, extended).otherwise(fresh)

    return range_text(F.aggregate(ordered.cast("array<int>"), start, step))


def series_coverage(series: DataFrame, reporting_years: DataFrame) -> DataFrame:
    """Holes inside each series and whether it stops before the company's reporting span does.

    reporting_years: (company_id, last_year). A series that starts late is not a gap; one that stops early is.
    """
    spans = series.groupBy("company_id", "series_id").agg(
        F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("series_end"), F.collect_set("fiscal_year").alias("years"),
        F.countDistinct("currency").alias("currencies"), F.count("*").alias("points"),
    )
    holes = F.array_sort(F.array_except(F.sequence("first_year", "series_end"), "years"))
    return spans.join(reporting_years, "company_id").select(
        "company_id", "series_id", "first_year", "series_end", "points", "currencies", holes.alias("holes"),
        F.when(F.col("series_end") < F.col("last_year"), F.col("series_end")).alias("truncated_after"),
    )


def dominant_reasons(refused: DataFrame) -> DataFrame:
    """The most frequent refusal per series from (company, analytic, reason, n); ties by name."""
    return refused.groupBy("company_id", "analytic_id").agg(F.min_by("reason", F.struct(-F.col("n"), "reason")).alias("reason"))


def chart_status(series: DataFrame, charts: DataFrame) -> DataFrame:
    """Per (company, chart): points drawn and why it is skipped, if it is. charts: (framework, chart_id, series_id, format)."""
    per_series = series.groupBy("company_id", "framework", "series_id").agg(
        F.count("*").alias("points"), F.min("currency").alias("low"), F.max("currency").alias("high")
    )
    joined = charts.join(per_series, ["framework", "series_id"])
    return joined.groupBy("company_id", "chart_id", "format").agg(
        F.max("points").alias("longest"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("series_drawn")
    ).select(
        "company_id", "chart_id", "series_drawn",
        F.when(F.col("longest") < 2, "fewer_than_two_points")
        .when((F.col("format") == "currency") & (F.col("low").isNull() | (F.col("low") != F.col("high"))), "currency_not_uniform").alias("skipped"),
    )


KNOCK_ON = "^(prior_year_not_projected|input_not_projected|input_not_computed|start_of_history)"


def gap_rollup(counts: DataFrame) -> DataFrame:
    """(company, item, reason, sentence, n) to one row per item: the total, and its two most frequent sentences, where
    reasons that only pass on an upstream failure give way to root causes. Codes that read the same count together and
    are shown as the most frequent of them."""
    item = ["company_id", "item"]
    said = counts.withColumn("root", ~F.col("reason").rlike(KNOCK_ON)).groupBy(*item, "sentence", "root").agg(
        F.sum("n").alias("n"), F.min_by("reason", F.struct(-F.col("n"), "reason")).alias("reason"))
    root = F.col("root")
    per_item = Window.partitionBy(*item)
    ranked = said.withColumn("has_root", F.max(root).over(per_item)).withColumn("total", F.sum("n").over(per_item))
    kept = ranked.filter(root | ~F.col("has_root"))
    place = F.row_number().over(per_item.orderBy(F.col("n").desc(), "reason"))
    top = kept.withColumn("place", place).filter("place <= 2")
    return top.groupBy(*item, "total").agg(
        F.min_by("reason", "place").alias("main_reason"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "reason"))), lambda s: s["reason"]), " ").alias("reasons"),
    )
