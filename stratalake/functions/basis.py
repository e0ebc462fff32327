"""Temporal basis functions: expressions of decimal time, and the order in which a decomposition lists them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def heaviside(t: Column) -> Column:
    return F.when(t >= 0, 1.0).when(t < 0, 0.0)


def box(t: Column) -> Column:
    """1 from half a unit before to half a unit after the origin."""
    return heaviside(t + 0.5) - heaviside(t - 0.5)


def step(t: Column, at: float) -> Column:
    return heaviside(t - at)


def postseismic(t: Column, at: float, tau: float) -> Column:
    """log10 of one plus the time since `at` in units of tau; 0 before."""
    return F.log10(1 + F.greatest((t - at) / F.lit(tau), F.lit(0.0)))


def constant(t: Column) -> Column:
    return F.when(t.isNotNull(), 1.0)


def linear(t: Column, origin: float) -> Column:
    return t - F.lit(origin)


def harmonic(t: Column, origin: float, cycles: float, cosine: bool = False) -> Column:
    """sin or cos of `cycles` turns a year: 1 annual, 2 semi-annual, 0.5 bi-annual."""
    angle = F.lit(2 * PI * cycles) * (t - F.lit(origin))
    return F.cos(angle) if cosine else F.sin(angle)


def growing_harmonic(t: Column, origin: float, cosine: bool = False) -> Column:
    """An annual term whose amplitude grows with time."""
    return (t - F.lit(origin)) * harmonic(t, origin, 1.0, cosine)


def slow_slip(t: Column, at: float, tau: float) -> Column:
    return 0.5 * (1 + F.tanh((t - F.lit(at)) / F.lit(tau)))


def degree_days(t: Column, origin: float, freeze: float, thaw: float) -> Column:
    """Stefan's law: root of the thawing time less alpha times the root of the freezing time, by the part of the year.

    `freeze` and `thaw` (fractions of a year) bound the thaw; outside of it the
    thawing time is the whole of it, and frost counts from its end.
    """
    day = F.pmod(t - F.lit(origin), F.lit(1.0))
    length = thaw - freeze
    alpha = math.sqrt(length / (1 - length))
    thawing = F.when((day > freeze) & (day < thaw), day - freeze).otherwise(length)
    freezing = F.when(day > thaw, day - thaw).when(day < freeze, day + 1 - thaw).otherwise(0.0)
    return F.when(day.isNotNull(), F.sqrt(thawing) - alpha * F.sqrt(freezing))


def temperature(t: Column, slope: float, cosine: float, sine: float, offset: float) -> Column:
    """A trend, an annual cycle and an offset."""
    return slope * t + cosine * F.cos(2 * PI * t) + sine * F.sin(2 * PI * t) + offset


@dataclass(frozen=True)
class Term:
    """A named column of a design matrix."""

    name: str
    value: Column
    kind: str = "linear"


def terms(
    t: Column, origin: float, *, linear_term: bool = True, seasonal: bool = False, seasonal_increase: bool = False, semiannual: bool = False, biannual: bool = False,
    steps: Sequence[float] = (), postseismic_terms: Sequence[tuple[float, float]] = (), slow_slips: Sequence[tuple[float, float]] = (), kernels: Sequence[tuple[str, Column]] = (),
) -> list[Term]:
    """The chosen terms; their order is fixed: reference, linear, seasonal, increase, semi, bi, steps, postseismic, slow slip, kernels."""
    out = [Term("reference", constant(t))]
    if linear_term:
        out.append(Term("linear", linear(t, origin)))
    for wanted, name, make in (
        (seasonal, "seasonal", lambda c: harmonic(t, origin, 1.0, c)),
        (seasonal_increase, "increase", lambda c: growing_harmonic(t, origin, c)),
        (semiannual, "semi", lambda c: harmonic(t, origin, 2.0, c)),
        (biannual, "bi", lambda c: harmonic(t, origin, 0.5, c)),
    ):
        if wanted:
            out += [Term(f"{name}_sin", make(False), name), Term(f"{name}_cos", make(True), name)]
    out += [Term(f"step_{i}", step(t, at), "step") for i, at in enumerate(steps)]
    out += [Term(f"post_{i}", postseismic(t, at, tau), "post") for i, (at, tau) in enumerate(postseismic_terms)]
    out += [Term(f"slip_{i}", slow_slip(t, at, tau), "slip") for i, (at, tau) in enumerate(slow_slips)]
    return out + [Term(name, value, "kernel") for name, value in kernels]
