"""Scalar functions of pixel values and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRETCH = 8.0
MAX_FLOAT32 = 3.4028234663852886e38


def clip(v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def finite_or_zero(v: Column) -> Column:
    """NaN and both infinities to 0."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def finite_or_largest(v: Column) -> Column:
    """NaN to 0, infinities to the largest single-precision value of their sign."""
    return F.when(F.isnan(v), 0.0).when(v == float("inf"), MAX_FLOAT32).when(v == float("-inf"), -MAX_FLOAT32).otherwise(v)


def arcsinh_stretch(v: Column, black: Column, white: Column, k: float = STRETCH) -> Column:
    x = clip((finite_or_zero(v) - black) / (white - black))
    return clip(F.asinh(x * k) / F.asinh(F.lit(k)))


def quantise_truncating(v: Column, top: int = 65535) -> Column:
    return F.least(F.lit(float(top)), F.greatest(F.lit(0.0), v * top)).cast("int")


def quantise_rounding(v: Column, top: int = 65535) -> Column:
    """Half to even, after the clip."""
    return F.rint(clip(v) * top).cast("int")


def dequantise(v: Column, top: int = 65535) -> Column:
    return v / F.lit(float(top))


def to_signed_unit(v: Column) -> Column:
    return v * 2 - 1


def from_signed_unit(v: Column) -> Column:
    return clip((v + 1) / 2)


def turned(y: Column, x: Column, height: Column, width: Column, flip_h: Column, flip_v: Column, rot_k: Column) -> tuple[Column, Column]:
    """Coordinates after a horizontal flip, a vertical flip and rot_k counter-clockwise quarter turns, in that order."""
    x, y = F.when(flip_h, width - 1 - x).otherwise(x), F.when(flip_v, height - 1 - y).otherwise(y)
    ty = F.when(rot_k == 1, width - 1 - x).when(rot_k == 2, height - 1 - y).when(rot_k == 3, x).otherwise(y)
    tx = F.when(rot_k == 1, y).when(rot_k == 2, width - 1 - x).when(rot_k == 3, height - 1 - y).otherwise(x)
    return ty, tx
