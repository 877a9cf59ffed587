"""Scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(c: Column) -> Column:
    """NaN to NULL: missing data is NULL only, as NaN would enter averages."""
    return F.nanvl(c, F.lit(None).cast("double"))


def to_number(c: Column) -> Column:
    """Text to double; what is not a number becomes NULL.

    Spark reads Java's ``1.5f`` / ``1.5d`` as numbers, a sensor log does not.
    """
    return no_nan(F.when(~F.regexp_like(c, F.lit(r"\d\.?[dDfF]\s*$")), c.try_cast("double")))


def mask_zero(c: Column) -> Column:
    """Zero (and -0.0) to NULL: a probe that dropped out reads 0."""
    return F.when(c != 0.0, c)


def softplus(c: Column) -> Column:
    """``log(1 + e^x)``, written so that large x does not overflow."""
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Clamp an actuator; missing stays missing."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def fingerprint(names: Sequence[str]) -> Column:
    """SHA-256 of the ordered names joined by ``|``."""
    return F.sha2(F.array_join(F.array(*[F.lit(n) for n in names]), "|"), 256)
