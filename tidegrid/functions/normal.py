"""Normal distribution as column expressions (Spark has no erf)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published rational approximations, error function to 1e-7 and its inverse.
_ERF = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
_INV_CENTRE = [2.81022636e-08, 3.43273939e-07, -3.5233877e-06, -4.39150654e-06, 0.00021858087, -0.00125372503, -0.00417768164, 0.246640727, 1.50140941]
_INV_TAIL = [-0.000200214257, 0.000100950558, 0.00134934322, -0.00367342844, 0.00573950773, -0.0076224613, 0.00943887047, 1.00167406, 2.83297682]


def _polynomial(x: Column, high_first: list[float]) -> Column:
    out = F.lit(high_first[0])
    for c in high_first[1:]:
        out = out * x + F.lit(c)
    return out


def erf(x: Column) -> Column:
    t = 1 / (1 + 0.5 * F.abs(x))
    tail = t * F.exp(_polynomial(t, _ERF[::-1]) - x * x)
    return F.when(x >= 0, 1 - tail).otherwise(tail - 1)


def erfinv(x: Column) -> Column:
    w = -F.log((1 - x) * (1 + x))
    centre = _polynomial(w - 2.5, _INV_CENTRE)
    tail = _polynomial(F.sqrt(F.greatest(w, F.lit(0.0))) - 3.0, _INV_TAIL)
    return F.when(w < 5.0, centre).otherwise(tail) * x


def normal_cdf(x: Column) -> Column:
    return (erf(x / math.sqrt(2.0)) + 1) / 2


def normal_ppf(p: Column) -> Column:
    """Inverse of the CDF. Fixed value: probabilities are held 1e-6 off 0 and 1."""
    inside = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return math.sqrt(2.0) * erfinv(2 * inside - 1)
