"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(eps)))


def clamp(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def fp8_e4m3(byte: Column) -> Column:
    """Value of a byte of 1 sign, 4 exponent, 3 mantissa bits, bias 7; 0x7F and 0xFF are NaN."""
    sign = F.when(byte >= 128, -1.0).otherwise(1.0)
    e, m = F.shiftright(byte, 3).bitwiseAND(15), byte.bitwiseAND(7)
    value = F.when(e == 0, m / 8.0 * 2.0**-6).otherwise((1 + m / 8.0) * F.pow(F.lit(2.0), e - 7))
    return F.when(byte.bitwiseAND(127) == 127, F.lit(float("nan"))).otherwise(sign * value)


def e8m0(byte: Column) -> Column:
    """2 to the power of the byte less 127; 255 is NaN."""
    return F.when(byte == 255, F.lit(float("nan"))).otherwise(F.pow(F.lit(2.0), byte.cast("double") - 127))
