"""Rules over columns: ramps, scores, labels by priority, first reasons, code maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rise(value: Column, low: float, high: float) -> Column:
    """0 below ``low``, 1 above ``high``, linear between; null stays null."""
    ramp = (value - low) / (high - low)
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), ramp)))


def fall(value: Column, low: float, high: float) -> Column:
    return 1 - rise(value, low, high)


def score(terms: list[tuple[float, Column]], gate: Column | None = None, factor: float = 1.0) -> Column:
    """Weighted sum of terms, null unless all are known; 0 where the gate is shut."""
    total = reduce(lambda a, b: a + b, (t * w for w, t in terms)) * factor
    return total if gate is None else F.when(gate, total).when(~gate, total * 0)


def best_label(scores: list[tuple[str, Column]]) -> tuple[Column, Column, Column]:
    """(label, top, confidence): the highest positive score, of ties the earliest; confidence from top and margin."""
    ranked = F.array(*(F.struct(F.coalesce(c, F.lit(0.0)).alias("s"), F.lit(-i).alias("p"), F.lit(name).alias("n")) for i, (name, c) in enumerate(scores)))
    order = F.sort_array(ranked, asc=False)
    top, second = F.element_at(order, 1), F.element_at(order, 2)
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.55 * top["s"] + 0.45 * F.greatest(F.lit(0.0), top["s"] - second["s"])))
    return F.when(top["s"] > 0, top["n"]), top["s"], F.when(top["s"] > 0, conf).otherwise(0.0)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that holds, else null."""
    return F.coalesce(*(F.when(cond, F.lit(name)) for name, cond in rules))


def text_or_null(column: str) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def scale_group(column: str) -> Column:
    """Feature name with its ring or distance suffix collapsed."""
    return F.regexp_replace(F.regexp_replace(F.col(column), r"_RING_\d+", "_SCALE"), r"_\d+KM", "_SCALE")
