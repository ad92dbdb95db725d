"""Column expressions: keys, remedies, physics, text and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def low_end(a, b) -> Column:
    """The smaller end of an undirected edge."""
    return F.least(col(a), col(b))


def high_end(a, b) -> Column:
    return F.greatest(col(a), col(b))


def clip(x, low, high) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def open_interval(start, end, year: int) -> Column:
    """In operation in ``year``: a missing bound is no bound."""
    return (col(start).isNull() | (col(start) <= year)) & (col(end).isNull() | (col(end) >= year))


def ladder(steps: list[tuple[Column, object]], default=None) -> Column:
    """First step whose condition holds."""
    out = F.lit(default)
    for condition, value in reversed(steps):
        out = F.when(condition, value).otherwise(out)
    return out


def balance_hinge(share, floor: float) -> Column:
    """Squared shortfall below a floor, 0 above it."""
    return F.when(col(share) >= floor, 0.0).otherwise(F.pow((floor - col(share)) / floor, 2))


def referred(x, v, v_ref: float) -> Column:
    """Impedance seen from another voltage."""
    ratio = F.lit(v_ref) / col(v)
    return col(x) * ratio * ratio


def susceptance(x) -> Column:
    return F.try_divide(F.lit(1.0), col(x))


def equirectangular_km(lon, lat) -> tuple[Column, Column]:
    return col(lon) * 111.32 * F.cos(F.radians(col(lat))), col(lat) * 110.57


def cubic_power(v, cut_in: float, rated: float, cut_out: float, losses: float) -> Column:
    """Power of a turbine as a share of its capacity."""
    v = col(v)
    rise = (v * v * v - cut_in**3) / (rated**3 - cut_in**3)
    return (1 - losses) * F.when((v < cut_in) | (v >= cut_out), 0.0).when(v >= rated, 1.0).otherwise(rise)


def required_reduction(flow, limit, sensitivity, tol: float) -> Column:
    """What a unit of relief has to remove; infinite where it works the wrong way."""
    over = F.abs(col(flow)) - col(limit)
    works = -F.signum(col(flow)) * col(sensitivity)
    return F.when(over <= tol, 0.0).when(works <= 0, F.lit(float("inf"))).otherwise(over / works)


def simpson_weight(k, n, step) -> Column:
    """Composite Simpson weight of sample k of n (n odd)."""
    k = col(k)
    return F.when((k == 0) | (k == col(n) - 1), col(step) / 3).when(k % 2 == 1, 4 * col(step) / 3).otherwise(2 * col(step) / 3)


def utc(ts, zone: str) -> Column:
    """A local wall clock as naive UTC."""
    return F.to_utc_timestamp(col(ts), zone).cast("timestamp_ntz")
