"""Metrics of ray vectors (one length a bearing) on arrays, without exploding them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def ray_metrics(rays: str, n: int, cap: float, open_share: float = 0.9) -> dict[str, Column]:
    """Widths of opposite pairs, fetch, openness, enclosure, embayment, aperture."""
    r = F.col(rays)
    half = n // 2
    axis = F.zip_with(F.slice(r, 1, half), F.slice(r, half + 1, half), lambda a, b: a + b)
    mean, top = _sum(r) / n, F.array_max(r)
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    openness = clip(mean / cap)
    low = F.array_min(axis)
    return {
        "width_min": low,
        "width_mean": _sum(axis) / half,
        "width_std": F.sqrt(_sum(F.transform(axis, lambda x: (x - _sum(axis) / half) * (x - _sum(axis) / half))) / half),
        "narrow_bearing": (F.array_position(axis, low) - 1).cast("int"),
        "fetch_mean": mean,
        "fetch_max": top,
        "openness": openness,
        "enclosure": 1 - openness,
        "embayment": clip(top / cap - openness),
        "aperture": F.size(F.filter(r, lambda x: x >= open_share * cap)) * (360.0 / n),
        "censored": F.size(F.filter(r, lambda x: x >= cap)) / F.lit(float(n)),
    }


def circular_mean(degrees: str, eps: float = 1e-12) -> tuple[Column, Column]:
    """Aggregates: mean direction in [0, 360) and resultant length; the direction is null where the length vanishes."""
    s, c = F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    length = F.sqrt(s * s + c * c)
    turn = F.degrees(F.atan2(s, c))
    return F.when(length > eps, F.when(turn < 0, turn + 360).otherwise(turn)), length
