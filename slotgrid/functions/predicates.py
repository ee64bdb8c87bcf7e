"""Null-safe tests of raw values."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = sys.float_info.max


def blank(text: Column) -> Column:
    """True where nothing but spaces is given: null, empty, or spaces alone."""
    return F.nullif(F.trim(text), F.lit("")).isNull()


def usable(number: Column) -> Column:
    """True where a double is a number between the infinities; null, NaN (which sorts above all numbers) and the infinities are not."""
    return F.coalesce(number.between(-LARGEST, LARGEST), F.lit(False))
