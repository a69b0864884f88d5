"""Scalar functions of numbers, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest(value: Column | str, digits: int) -> Column:
    """value to so many digits by its product with a power of ten, halves away from zero, as SQL engines round doubles. F.round() takes the shortest decimal that a double
    prints as for its value: 34.995, which is below its last digit, becomes 35.0 there and 34.99 here."""
    by = 10.0**digits
    return F.round((F.col(value) if isinstance(value, str) else value) * by, 0) / by
