"""Fiscal calendar as column expressions: dates in, fiscal year and period code (or a reason) out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Inclusive day counts for each kind of period, and the 52/53-week spillover into the next month.
ANNUAL_DAYS = (350, 380)
QUARTER_DAYS = (80, 100)
HALF_DAYS = (170, 195)
NINE_MONTH_DAYS = (260, 285)
SPILLOVER_DAYS = 7
PERIOD_ORDER = ("Q1", "H1", "Q2", "9M", "Q3", "H2", "Q4", "FY")


def effective_month_end(day: Column) -> Column:
    """The month a period end belongs to: the first days of a month still count for the month before."""
    return F.last_day(F.date_sub(day, SPILLOVER_DAYS))


def days_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + F.lit(1)


def within(days: Column, bounds: tuple[int, int]) -> Column:
    return days.between(*bounds)


def fiscal_year_of(year: Column, month: Column, fye_month: Column, convention: Column) -> Column:
    ends_in = F.when(month <= fye_month, year).otherwise(year + 1)
    names_start = (convention == "start_year") & (fye_month != 12)
    return F.when(names_start, ends_in - 1).otherwise(ends_in)


def _offset(month_end: Column, fye_month: Column) -> Column:
    return F.pmod(F.month(month_end) - fye_month, F.lit(12))


def _verdict(start: Column, end: Column, offset: Column) -> Column:
    """A period code or, prefixed with '!', the reason there is none."""
    quarter = F.when(offset == 0, 4).otherwise((offset / 3).cast("int"))
    days = days_inclusive(start, end)
    quarter_code = F.concat(F.lit("Q"), quarter.cast("string"))
    return (
        F.when(offset % 3 != 0, "!period_end_not_fiscal_quarter_end")
        .when(start.isNull(), F.when(quarter == 4, "FY").otherwise(quarter_code))
        .when(start >= end, "!invalid_period_dates")
        .when(within(days, ANNUAL_DAYS), F.when(quarter == 4, "FY").otherwise("!annual_duration_not_ending_at_fiscal_year_end"))
        .when(within(days, QUARTER_DAYS), quarter_code)
        .when(
            within(days, HALF_DAYS),
            F.when(quarter == 2, "H1").when(quarter == 4, "H2").otherwise("!half_year_not_aligned_to_fiscal_halves"),
        )
        .when(within(days, NINE_MONTH_DAYS), F.when(quarter == 3, "9M").otherwise("!nine_month_not_ending_at_fiscal_q3"))
        .otherwise("!unsupported_duration")
    )


def _period(verdict: Column, month_end: Column, fye_month: Column, convention: Column) -> Column:
    refused = verdict.startswith("!")
    return F.struct(
        F.when(~refused, fiscal_year_of(F.year(month_end), F.month(month_end), fye_month, convention)).cast("int").alias("fiscal_year"),
        F.when(~refused, verdict).alias("fiscal_period"),
        F.when(refused, F.substring(verdict, 2, 100)).alias("skip_reason"),
    )


def classify(start: Column, end: Column, fye_month: Column, convention: Column) -> Column:
    """struct<fiscal_year, fiscal_period, skip_reason>; exactly one of fiscal_period and skip_reason is set.

    The source's own fy/fp fields describe the filing rather than the value's period, so they are never read.
    """
    month_end = effective_month_end(end)
    return _period(_verdict(start, end, _offset(month_end, fye_month)), month_end, fye_month, convention)


def with_period(df: DataFrame) -> DataFrame:
    """`classify` of period_start, period_end, fye_month and convention as column `period`. What its parts share is a
    column of its own, since an expression is worked out as often as others mention it."""
    col = F.col
    staged = df.withColumn("_month_end", effective_month_end(col("period_end"))).withColumn("_offset", _offset(col("_month_end"), col("fye_month")))
    staged = staged.withColumn("_verdict", _verdict(col("period_start"), col("period_end"), col("_offset")))
    return staged.withColumn("period", _period(col("_verdict"), col("_month_end"), col("fye_month"), col("convention"))).drop("_month_end", "_offset", "_verdict")


def period_label(fiscal_year: Column, fiscal_period: Column) -> Column:
    year = fiscal_year.cast("string")
    return F.when(fiscal_period == "FY", F.concat(F.lit("FY"), year)).otherwise(F.concat(fiscal_period, F.lit("-"), year))


def period_rank(fiscal_period: Column) -> Column:
    """Chronological position of a period code inside its fiscal year."""
    order = F.array(*[F.lit(code) for code in PERIOD_ORDER])
    return F.array_position(order, fiscal_period)


def fye_month_from_mmdd(mmdd: Column) -> Column:
    """'1231' -> 12, '0103' -> 12, '0628' -> 6; null when it is not a valid month and day."""
    day = F.try_to_date(F.concat(F.lit("2001"), mmdd), "yyyyMMdd")
    return F.when(mmdd.rlike(r"^\d{4}$"), F.month(effective_month_end(day)))


def nominal_year_end(fiscal_year: Column, fye_month: Column, convention: Column) -> Column:
    """Last day of a fiscal year when the company's own dates are not known."""
    shift = F.when((convention == "start_year") & (fye_month != 12), 1).otherwise(0)
    return F.last_day(F.make_date(fiscal_year + shift, fye_month, F.lit(1)))
