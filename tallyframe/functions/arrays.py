"""Helpers for array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(**fields: Column) -> Column:
    """A struct whose field names hold inside array functions."""
    return F.named_struct(*[part for name, value in fields.items() for part in (F.lit(name), value)])


def once(value: Column) -> Column:
    """For a select: a value that is computed once a row, whatever filters and columns come after it.

    Spark moves a filter in front of the columns it tests by writing their whole expression into it, in every term, and
    computes them again behind it. It does not move one in front of an explode.
    """
    return F.explode(F.array(value))
