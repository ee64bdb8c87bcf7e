"""Positions on a cycle as points on a circle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def on_circle(position: Column, period: float, name: str) -> dict[str, Column]:
    """`<name>_sin` and `<name>_cos` of a position in a cycle of `period`; null for a null position."""
    angle = 2 * F.pi() * position / period
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def clock_and_season(at: Column) -> dict[str, Column]:
    """Hour of the day and month of the year of a timestamp on their circles, in the session zone; January is the angle 0."""
    return on_circle(F.hour(at) + F.minute(at) / 60, 24, "hour") | on_circle(F.month(at) - 1, 12, "month")
