"""Distribution metrics as columns.

The two-distribution metrics are sums over the classes that both distributions
have: a class of one alone adds a constant to each of them.  So a pair needs an
inner join on the class and no zero-filled scaffold, however large the catalog.
``p`` and ``q`` are probabilities of a shared class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def tv_shared(p: Column, q: Column) -> Column:
    """Total variation: 1 - sum of min(p, q)."""
    return 1 - _sum(F.least(p, q))


def js_shared(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits; never below 0, NaN stays NaN."""
    both = p + q
    common = _sum((p * F.log2(2 * p / both) + q * F.log2(2 * q / both)) / 2)
    return F.greatest(F.lit(0.0), common + (2 - _sum(both)) / 2)


def hellinger_shared(p: Column, q: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 1 - _sum(F.sqrt(p * q))))


#: name -> aggregate over the shared classes' (p, q) of a pair.
PAIR_METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "tv": tv_shared,
    "js": js_shared,
    "js_distance": lambda p, q: F.sqrt(js_shared(p, q)),
    "hellinger": hellinger_shared,
}


def entropy(p: Column) -> Column:
    """Entropy in bits of one distribution's probabilities (an aggregate); zero mass counts nothing."""
    return _sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0))


def normalized_entropy(h: Column, classes: Column, tolerance: float = 1e-10) -> Column:
    """Entropy over its maximum for the catalog's number of classes (two or more), clamped within a tolerance."""
    x = h / F.log2(classes)
    return F.when((x < 0) & (x > -tolerance), 0.0).when((x > 1) & (x < 1 + tolerance), 1.0).otherwise(x)


def smoothed(n: Column) -> Column:
    """ln((n+1/2)/(1/2)): the smoothed log density less what is the same for all classes of the item."""
    return F.log(2 * n + 1)


def pearson(k: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, least: float = 1e-12) -> Column:
    """Correlation from sums over k pairs; null where a side is constant."""
    vx, vy = k * sxx - sx * sx, k * syy - sy * sy
    return F.when((vx > least) & (vy > least), (k * sxy - sx * sy) / (F.sqrt(F.greatest(vx, F.lit(least))) * F.sqrt(F.greatest(vy, F.lit(least)))))


def normalized_attraction(gain: Column, before: Column) -> Column:
    """gain / (1 - before); null where nothing was left to gain; negatives stay."""
    return F.when(before != 1.0, F.try_divide(gain, 1 - before))


def directional_gain(before: Column, after: Column, least: float = 1e-12) -> Column:
    """(after - before) / max(0, 1 - before), null where the gap is not above ``least``."""
    gap = F.greatest(F.lit(0.0), 1 - before)
    return F.when(gap > least, F.try_divide(after - before, gap))


def choice_accuracy_bounds(tv_to_uniform: Column, classes: Column) -> tuple[Column, Column]:
    return 1 / classes + tv_to_uniform, F.least(F.lit(1.0), (1 + classes * tv_to_uniform) / classes)


def source_accuracy_bound(tv: Column) -> Column:
    return (1 + tv) / 2


def chance_to_ceiling(accuracy: Column, chance: Column, ceiling: Column, least: float = 1e-12) -> Column:
    room = ceiling - chance
    return F.when(room > least, F.try_divide(accuracy - chance, room)).otherwise(0.0)
