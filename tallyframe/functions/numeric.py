"""Exact-decimal helpers: presentation units, rounding tolerances, printed and tagged numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MONEY

MAX_PRESENTATION_EXPONENT = 6
MONEY_SCALE = 8


def exponent_of(value: Column) -> Column:
    """Power of ten of the last non-zero digit (at most a million); null for zero."""
    digits = F.translate(F.abs(value.cast(MONEY)).cast("string"), ".", "")
    # Spark prints small decimals as 5E-8; formatting keeps the digits positional.
    digits = F.when(F.abs(value) < F.lit("0.000001").cast(MONEY), F.format_string("%09d", (value.cast(MONEY) * 100000000).cast("long"))).otherwise(digits)
    zeros = F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
    return F.when(value != 0, F.least(zeros - F.lit(MONEY_SCALE), F.lit(MAX_PRESENTATION_EXPONENT)))


def presentation_unit(value: Column) -> Column:
    return F.pow(F.lit(10.0), exponent_of(value)).cast(MONEY)


def rounding_tolerance(values: Column) -> Column:
    """n terms, each rounded to a unit u, can miss their rounded total by n*u/2. Zeros count as terms."""
    present = F.filter(values, lambda v: v.isNotNull())
    smallest = F.array_min(F.transform(present, exponent_of))
    half_units = F.size(present).cast("decimal(10,0)") * F.pow(F.lit(10.0), smallest).cast(MONEY) / F.lit(2).cast("decimal(10,0)")
    return F.coalesce(half_units.cast(MONEY), F.lit(0).cast(MONEY))


def clean_text(text: Column) -> Column:
    """Whitespace runs and non-breaking spaces become single blanks."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ]+", " "))


def printed_number(text: Column) -> Column:
    """'(1,234)' -> -1234, '$ 5.2%' -> 5.2; null when the text is not one number."""
    raw = F.regexp_replace(clean_text(text), r"[$ ]", "")
    shape = raw.rlike(r"^\(?-?[\d,]*\.?\d+%?\)?$")
    negative = (raw.startswith("(") & raw.endswith(")")) | raw.startswith("-")
    digits = F.regexp_replace(raw, r"[(),%\-]", "")
    number = digits.try_cast(MONEY)
    return F.when(shape, F.when(negative, -number).otherwise(number)).cast(MONEY)


def tagged_number(text: Column, fmt: Column, scale: Column, sign: Column) -> Column:
    """A displayed number under its tag's format, scaled by a power of ten and signed by the tag."""
    kind = F.lower(F.element_at(F.split(F.coalesce(fmt, F.lit("")), ":"), -1))
    raw = F.trim(F.coalesce(text, F.lit("")))
    kept = F.regexp_replace(raw, r"[^0-9.,]", "")
    comma_decimal = kind.contains("comma-decimal") | kind.contains("numcommadecimal")
    plain = F.when(comma_decimal, F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(
        F.replace(kept, F.lit(","), F.lit(""))
    )
    base = (
        F.when(kind.isin("fixed-zero", "fixedzero") | raw.isin("-", "—", "–"), F.lit(0).cast(MONEY))
        .when(kind.contains("numword") | (raw == ""), F.lit(None).cast(MONEY))
        .otherwise(plain.try_cast(MONEY))
    )
    # Shift the decimal point in the text rather than multiply, so no digit is lost to a decimal product.
    power = F.coalesce(scale.try_cast("int"), F.lit(0))
    shifted = F.when(power == 0, base).otherwise(F.concat(base.cast("string"), F.lit("E"), power.cast("string")).try_cast(MONEY))
    return F.when(F.coalesce(sign, F.lit("")) == "-", -shifted).otherwise(shifted).cast(MONEY)
