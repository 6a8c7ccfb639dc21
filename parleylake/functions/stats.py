"""Interval and agreement statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def _parts(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    p, zz = k / n, z * z
    middle = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return middle, half


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval, null where n is 0, not clamped."""
    k, n = k.cast("double"), F.when(n > 0, n.cast("double"))
    middle, half = _parts(k, n, z)
    return middle - half, middle + half


def wilson_clamped(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval inside [0, 1]; the whole of it where n is not positive."""
    low, high = wilson(k, n, z)
    return F.coalesce(F.greatest(low, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.least(high, F.lit(1.0)), F.lit(1.0))


def worst_half_width(n: Column, z: float = Z95) -> Column:
    return z * F.sqrt(F.lit(0.25) / n)


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z95) -> tuple[Column, Column]:
    """Hybrid score interval of a difference of rates."""
    (l1, u1), (l2, u2) = wilson(k1, n1, z), wilson(k2, n2, z)
    p1, p2 = k1.cast("double") / n1, k2.cast("double") / n2
    low = p1 - p2 - F.sqrt(F.pow(p1 - l1, F.lit(2.0)) + F.pow(u2 - p2, F.lit(2.0)))
    high = p1 - p2 + F.sqrt(F.pow(u1 - p1, F.lit(2.0)) + F.pow(p2 - l2, F.lit(2.0)))
    return low, high


def cohen_kappa(pairs: DataFrame, left: str, right: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, agreement and kappa of two label columns, by group; kappa null without rows or where chance agrees wholly."""
    keys = list(by)
    base = pairs.select(*keys, F.col(left).alias("l"), F.col(right).alias("r"))
    total = base.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("l").eqNullSafe(F.col("r"))).alias("agree"))
    sides = base.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("l").alias("label")), F.struct(F.lit(1).alias("side"), F.col("r").alias("label")))).alias("s"))
    marginal = sides.groupBy(*keys, F.col("s.label").alias("label")).agg(F.count_if(F.col("s.side") == 0).alias("a"), F.count_if(F.col("s.side") == 1).alias("b"))
    chance = marginal.groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("both"))
    joined = total.join(chance, keys) if keys else total.join(chance, F.lit(True))
    po, pe = F.col("agree") / F.col("n"), F.col("both") / (F.col("n") * F.col("n"))
    return joined.select(*keys, "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def percentile_at(values: Column, fraction: float, half_even: bool = False) -> Column:
    """Element of a sorted array at index ``(n - 1) * fraction``: cut down, or rounded half to even."""
    place = (F.size(values) - 1) * F.lit(fraction)
    index = F.bround(place, 0) if half_even else F.floor(place)
    return F.try_element_at(values, index.cast("int") + 1)


def quartiles(value: str) -> Column:
    """Minimum, quartiles and maximum with linear interpolation."""
    return F.percentile(value, [0.0, 0.25, 0.5, 0.75, 1.0])


def ladder(n: Column, steps: tuple[tuple[int, str], ...], below: str) -> Column:
    """The name of the highest step that n reaches."""
    out = F.lit(below)
    for least, name in sorted(steps):
        out = F.when(n >= least, F.lit(name)).otherwise(out)
    return out
