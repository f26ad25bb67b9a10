"""Arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def saturating_sub(a: Column, b: Column) -> Column:
    """Unsigned subtraction: never below zero."""
    return F.greatest(a - b, F.lit(0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def soft_pressure(pressure: Column, floor: float = 0.05) -> Column:
    """``1 - pressure`` within ``[floor, 1]``."""
    return F.greatest(F.lit(1.0) - clamp(pressure, 0.0, 1.0), F.lit(floor))


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != float("inf"))


def backoff_ms(attempt: Column, initial_ms: int, multiplier: int, max_ms: int) -> Column:
    """Exponential back-off for a 1-based attempt, saturating at ``max_ms``; zero settings count as one."""
    grown = F.lit(float(max(initial_ms, 1))) * F.pow(F.lit(float(max(multiplier, 1))), F.greatest(attempt - 1, F.lit(0)))
    return F.least(F.lit(float(max(max_ms, 1))), grown).cast("long")


def exact_sum(value: Column, scale: int = 6) -> Column:
    """Order-independent money sum: added as decimals, returned as double."""
    return F.sum(value.cast(f"decimal(28,{scale})")).cast("double")
