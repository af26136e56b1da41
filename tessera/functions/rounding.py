"""Rounding as SQL engines do it on doubles: x * 10^n to the nearest whole number, halves away from zero, over 10^n. Spark's own
round works on the shortest decimal form, numpy's takes halves to even numbers; both differ on numbers about halfway."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c * F.lit(10.0**digits)) / F.lit(10.0**digits)


def rounded_array(x: np.ndarray, digits: int = 6) -> np.ndarray:
    size = np.abs(x) * 10.0**digits
    whole = np.floor(size)
    return np.copysign((whole + (size - whole >= 0.5)) / 10.0**digits, x) + 0.0
