"""Citation titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def citation_title(title_format: Column, version: Column) -> Column:
    """Put the version into the ``{0}`` slot."""
    return F.replace(title_format, F.lit("{0}"), version)
