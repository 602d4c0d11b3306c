"""Running sums over an order, where no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group's distinct values are cut into.
RANGES = 256


def sums_below(bins: DataFrame, by: list[str], value: str, names: list[str], ranges: int = RANGES) -> DataFrame:
    """Adds <name>_below, the sum of each named column over the group's rows with a smaller value. bins has a row for each group and value, no value null; the groups are few
    (models, columns, folds), so their ranges are broadcast: `ranges` rows a group.

    Quantiles cut each group's values into ranges of about one size. Sums run over the ranges first, then inside each one, in tasks of their own."""
    q = F.array_distinct(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(10_000)))
    cuts = bins.groupBy(*by).agg(q.alias("_q"))
    # the range of a value by bisection: how many cuts are at or below it
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(ranges.bit_length()))])
    inside = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("_q", at + step - 1) <= F.col(value).cast("double"), step).otherwise(0))
    placed = bins.join(F.broadcast(cuts), by).withColumn("_lo", inside).drop("_q")
    over = lambda w, n: F.coalesce(F.sum(n).over(w), F.lit(0))
    ordered = Window.partitionBy(*by).orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_lo").agg(*[F.sum(n).alias(n) for n in names])
    before = totals.select(*by, "_lo", *[over(ordered, n).alias(f"_before_{n}") for n in names])
    own = Window.partitionBy(*by, "_lo").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(before), [*by, "_lo"])
    return out.select(*bins.columns, *[(over(own, n) + F.col(f"_before_{n}")).alias(f"{n}_below") for n in names])
