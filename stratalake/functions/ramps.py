"""Spatial ramps: the terms of each order, used alike for fitting and for applying."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spatial terms of the ramp orders 0 to 9, r along columns and a along lines.
ORDERS = {
    0: (),
    1: ("r", "cst"),
    2: ("a", "cst"),
    3: ("r", "a", "cst"),
    4: ("r", "a", "ra", "cst"),
    5: ("r2", "r", "a", "cst"),
    6: ("a2", "a", "r", "cst"),
    7: ("a2", "a", "r2", "r", "cst"),
    8: ("a3", "a2", "a", "r2", "r", "cst"),
    9: ("r", "a", "ra2", "ra", "cst"),
}
#: Order 6 of a ramp fitted to pairs has no term along columns.
PAIR_ORDERS = {**{k: ORDERS[k] for k in range(6)}, 6: ("a2", "a", "cst")}
#: The 13 slots of a pair's ramp record, in their order.
PAIR_SLOTS = ("r3", "r2", "r", "a3", "a2", "a", "ra2", "ra", "cst", "z", "z2", "az", "az2")


def topographic(flat: int, ivar: int, nfit: int) -> tuple[str, ...]:
    """Elevation terms: ivar 1 adds elevation times line, nfit 1 the square."""
    found = {(0, 0): ("z",), (0, 1): ("z", "z2"), (1, 0): ("z", "az"), (1, 1): ("az", "z", "z2")}[ivar, nfit]
    return found + (("az2",) if flat in (6, 8) and (ivar, nfit) == (1, 1) else ())


def names(flat: int, ivar: int = 0, nfit: int = 0, elevation: bool = False, pair: bool = False) -> tuple[str, ...]:
    """The terms of a ramp; a bad order counts as 0, which has a constant only beside elevation terms."""
    orders = PAIR_ORDERS if pair else ORDERS
    flat, ivar, nfit = (flat if flat in orders else 0), (ivar if ivar in (0, 1) else 0), (nfit if nfit in (0, 1) else 0)
    if not elevation:
        return orders[flat]
    return (orders[flat] or ("cst",)) + topographic(flat, ivar, nfit)


def value(name: str, r: Column, a: Column, z: Column | None = None) -> Column:
    """A term at a place."""
    r, a = r.cast("double"), a.cast("double")
    ra = r * a
    found = {"cst": lambda: F.lit(1.0), "r": lambda: r, "r2": lambda: r * r, "r3": lambda: r * r * r, "a": lambda: a, "a2": lambda: a * a, "a3": lambda: a * a * a, "ra": lambda: ra, "ra2": lambda: ra * ra}
    if z is not None:
        found |= {"z": lambda: z, "z2": lambda: z * z, "az": lambda: a * z, "az2": lambda: a * z * a * z}
    return found[name]()


def apply(coefficients: dict[str, Column], r: Column, a: Column, z: Column | None = None) -> Column:
    """The ramp's value; an absent or null coefficient adds nothing."""
    total = F.lit(0.0)
    for name, m in coefficients.items():
        total = total + F.coalesce(m, F.lit(0.0)) * value(name, r, a, z)
    return total


def azimuth_polynomial(x: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """a + b x + c x**2 + d x**4, the fourth term taken as it is meant."""
    return a + b * x + c * x * x + d * x * x * x * x
