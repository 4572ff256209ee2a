from decimal import Decimal

import pytest
from helpers import day
from pyspark.sql import functions as F

from tallyframe.functions import calendar, display, numeric, text
from tallyframe.functions.formula import FormulaError, formula


@pytest.mark.parametrize("fye,convention,start,end,expected", [
    (12, "end_year", "2025-01-01", "2025-12-31", (2025, "FY", None)),
    (12, "end_year", "2025-01-01", "2025-03-31", (2025, "Q1", None)),
    (12, "end_year", "2025-01-01", "2025-06-30", (2025, "H1", None)),
    (12, "end_year", "2025-01-01", "2025-09-30", (2025, "9M", None)),
    (12, "end_year", "2025-10-01", "2025-12-31", (2025, "Q4", None)),
    (12, "end_year", "2025-07-01", "2025-12-31", (2025, "H2", None)),
    (12, "end_year", "2025-03-01", "2025-11-30", (None, None, "period_end_not_fiscal_quarter_end")),
    (12, "end_year", "2024-07-01", "2025-06-30", (None, None, "annual_duration_not_ending_at_fiscal_year_end")),
    (12, "end_year", "2025-04-01", "2025-09-30", (None, None, "half_year_not_aligned_to_fiscal_halves")),
    (6, "end_year", "2025-01-01", "2025-09-30", (None, None, "nine_month_not_ending_at_fiscal_q3")),
    (12, "end_year", "2025-12-31", "2025-12-31", (None, None, "invalid_period_dates")),
    (12, "end_year", "2025-12-01", "2025-12-31", (None, None, "unsupported_duration")),
    (6, "end_year", "2025-07-01", "2025-09-30", (2026, "Q1", None)),
    (9, "end_year", "2024-09-29", "2024-12-28", (2025, "Q1", None)),
    (12, "end_year", "2024-12-29", "2026-01-03", (2025, "FY", None)),
    (12, "end_year", None, "2025-06-30", (2025, "Q2", None)),
    (6, "start_year", "2024-07-01", "2025-06-30", (2024, "FY", None)),
])
def test_classify(spark, fye, convention, start, end, expected):
    df = spark.createDataFrame([(day(start), day(end), fye, convention)], "s date, e date, f int, c string")
    assert tuple(df.select(calendar.classify(F.col("s"), F.col("e"), F.col("f"), F.col("c")).alias("p")).first().p) == expected


def test_fiscal_year_end_months(spark):
    df = spark.createDataFrame([("1231", 12), ("0103", 12), ("0930", 9), ("0628", 6), ("9999", None)], "v string, m int")
    assert all(r.m == r.got for r in df.select("m", calendar.fye_month_from_mmdd(F.col("v")).alias("got")).collect())


def test_presentation_units_and_tolerance(spark):
    one = lambda v: spark.range(1).select(numeric.presentation_unit(F.lit(v).cast("decimal(28,8)")).alias("u")).first().u
    assert [one("123456000000"), one("1234567000"), one("5.25"), one("0"), one("0.00000005")] == [Decimal(10**6), Decimal(1000), Decimal("0.01"), None, Decimal("1E-8")]
    values = F.array(*[F.lit(v).cast("decimal(28,8)") for v in (3000000, 1000, 2999000)])
    assert spark.range(1).select(numeric.rounding_tolerance(values).alias("t")).first().t == 1500


@pytest.mark.parametrize("raw,expected", [("(1,234)", -1234), ("$ 5.2%", Decimal("5.2")), ("—", None), ("12 months", None), ("-3", -3), ("2024", 2024)])
def test_printed_numbers(spark, raw, expected):
    assert spark.range(1).select(numeric.printed_number(F.lit(raw)).alias("v")).first().v == expected


@pytest.mark.parametrize("raw,fmt,scale,sign,expected", [
    ("1,234.5", None, None, None, Decimal("1234.5")), ("1.234,5", "ixt:num-comma-decimal", None, None, Decimal("1234.5")), ("—", "ixt:fixed-zero", "6", None, 0),
    ("twelve", "ixt:numwordsen", None, None, None), ("17,000", "ixt:num-dot-decimal", "6", None, 17_000_000_000), ("13.5", None, "-2", None, Decimal("0.135")), ("5", None, None, "-", -5),
])
def test_tagged_numbers(spark, raw, fmt, scale, sign, expected):
    lit = lambda v: F.lit(v).cast("string")
    assert spark.range(1).select(numeric.tagged_number(lit(raw), lit(fmt), lit(scale), lit(sign)).alias("v")).first().v == expected


def test_formula_columns(spark):
    df = spark.createDataFrame([(6.0, 3.0, 0.0)], "a double, b double, z double")
    value = lambda t: df.select(formula(t).column(F.col).alias("v")).first().v
    assert value("(a + b) * 2 / 3") == 6.0 and value("-a + b") == -3.0 and value("a / z") is None
    assert formula("a - b").additive and not formula("a * b").additive and not formula("a + 1").additive
    assert formula("b + a - b").names == ("a", "b")


@pytest.mark.parametrize("bad", ["__import__('os')", "a.b", "a[0]", "f(a)", "a ** 2", "lambda: 1", "'text'", "True", "a if b else c", "", "a" * 501])
def test_formula_rejects(bad):
    with pytest.raises(FormulaError):
        formula(bad)


def test_text_rules(spark):
    row = spark.range(1).select(
        text.normalize_label(F.lit("Average interest–earning assets (a) (b)")).alias("label"), text.stated_scale(F.lit("(In Millions, except)")).cast("double").alias("scale"),
        text.last_year_in(F.lit("2023 and 2024")).alias("year"), text.month_word(F.lit("Sept. 30, 2024")).alias("month"), text.slugify(F.lit("NYSE J P.M")).alias("slug"),
        text.media_type(F.lit("  <!DOCTYPE html><html>")).alias("media"), text.accession_from_url(F.lit("https://www.sec.gov/Archives/edgar/data/19617/000162828026008131/x.htm")).alias("acc"),
        display.period_words(F.lit("9M-2014")).alias("words"), display.date_words(F.lit("2026-02-13").cast("date")).alias("day"),
        display.phrase(F.lit("pre_tax_income - income_tax_expense"), F.create_map(F.lit("pre_tax_income"), F.lit("Pre-tax income"), F.lit("income_tax_expense"), F.lit("Income tax expense"))).alias("phrase"),
        display.distinct_amounts(F.array(F.lit(2414.94e9), F.lit(2414.96e9)), F.lit("currency"), F.lit("USD")).alias("two"),
    ).first()
    assert row.label == "average interest-earning assets" and row.scale == 1e6 and row.year == 2024 and row.month == 9 and row.slug == "nyse-j-p-m"
    assert row.media == "html" and row.acc == "0001628280-26-008131" and row.words == "9M FY2014" and row.day == "13 Feb 2026"
    assert row.phrase == "pre-tax income minus income tax expense" and len(set(row.two)) == 2
