"""Phases, amplitudes and complex values as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def wrap(x: Column, half: float = PI) -> Column:
    """Into [-half, half)."""
    return F.pmod(x + F.lit(half), F.lit(2 * half)) - F.lit(half)


def positive_phase(x: Column) -> Column:
    """Into [0, 2 pi)."""
    return F.pmod(x, F.lit(2 * PI))


def amplitude(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def phase(sine: Column, cosine: Column) -> Column:
    return F.atan2(sine, cosine)


def amplitude_sigma(sa: Column, sb: Column) -> Column:
    return F.sqrt(sa * sa + sb * sb)


def phase_sigma(sine: Column, cosine: Column, s_sine: Column, s_cosine: Column) -> Column:
    return F.try_divide(s_cosine * F.abs(sine) + s_sine * F.abs(cosine), s_cosine * s_cosine + s_sine * s_sine)


def rotate(re: Column, im: Column, angle: Column) -> tuple[Column, Column]:
    """A complex value turned by an angle."""
    return re * F.cos(angle) - im * F.sin(angle), re * F.sin(angle) + im * F.cos(angle)


def null_where(value: Column, *missing: float) -> Column:
    """Null instead of the listed values and of NaN."""
    clean = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return F.when(~clean.isin(*map(float, missing)), clean) if missing else clean


def rad_to_mm(x: Column, wavelength_m: float) -> Column:
    """Phase to displacement along the line of sight, towards the sensor positive."""
    return x * F.lit(-wavelength_m * 1000 / (4 * PI))
