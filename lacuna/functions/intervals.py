"""Intervals of signed years, and date values of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Years stay integers: as strings -0500 sorts after -0100, and Python cannot
# represent negative years.
_SPAN = r"^\s*(-?\d+)(?:-\d{2}-\d{2})?\s*/\s*(-?\d+)(?:-\d{2}-\d{2})?\s*$"


def timespan(c: Column) -> Column:
    """``start/end`` to STRUCT<start_year, end_year>; NULL if it is none."""
    return F.when(
        c.rlike(_SPAN),
        F.struct(
            F.regexp_extract(c, _SPAN, 1).try_cast("int").alias("start_year"),
            F.regexp_extract(c, _SPAN, 2).try_cast("int").alias("end_year"),
        ),
    )


def overlaps(a: Column, b: Column) -> Column:
    return (a["start_year"] <= b["end_year"]) & (b["start_year"] <= a["end_year"])


def contains_year(span: Column, year: Column) -> Column:
    """As-of test: is ``year`` inside the interval?"""
    return (span["start_year"] <= year) & (year <= span["end_year"])
