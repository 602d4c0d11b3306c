"""Rank averaging, folds and complete output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import sums_below


def rank_normalize(cells: DataFrame) -> DataFrame:
    """Adds r by (model, column): average-tie rank scaled to 0..1 over all rows, null rows counted but unranked; 0.5 for a single row.

    Ranks come from counts by distinct score, over ranges of scores, joined back; a score that very many rows tie at is one row on the joined side."""
    by = ["model", "column"]
    sizes = cells.groupBy(*by).agg(F.count("*").alias("n"))
    bins = cells.where("p IS NOT NULL").groupBy(*by, "p").agg(F.count("*").alias("c"))
    rank = F.col("c_below") + (F.col("c") + 1) / 2.0
    r = F.when(F.col("n") == 1, 0.5).otherwise((rank - 1) / (F.col("n") - 1))
    ranks = sums_below(bins, by, "p", ["c"]).join(F.broadcast(sizes), by).select(*by, "p", r.alias("r"))  # a row a model and column
    return cells.join(ranks, [*by, "p"], "left")


def rank_average(cells: DataFrame, weights: dict[str, float], key: str = "doc_id") -> DataFrame:
    """key, column, p: weighted mean of normalized ranks over the models that have rows, a missing score counting 0.5. Keys and columns are those of the first
    such model in `weights`; if it is the only one, its scores pass unchanged. Models without rows don't weigh; none left is an error."""
    there = {r.model for r in cells.select("model").distinct().where(F.col("model").isin(*weights)).collect()} if weights else set()
    left = {m: float(w) for m, w in weights.items() if m in there}  # a row a model
    if not left:
        raise ValueError("no model has rows")
    head = next(iter(left))
    if len(left) == 1:
        return cells.where(F.col("model") == head).select(key, "column", "p")
    # every model gets the first one's keys and columns, with null where it has no score, so that ranks are over the same rows
    grid = cells.where(F.col("model") == head).select(key, "column", F.explode(F.array(*map(F.lit, left))).alias("model"))
    ranked = rank_normalize(grid.join(cells.select(key, "column", "model", "p"), [key, "column", "model"], "left"))
    w = F.create_map(*[x for k, v in left.items() for x in (F.lit(k), F.lit(v))])
    drawn = F.sum((F.coalesce("r", F.lit(0.5)) - 0.5) * w[F.col("model")])
    return ranked.groupBy(key, "column").agg((0.5 + drawn / F.lit(sum(left.values()))).alias("p"))


def probability_average(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    return cells.groupBy(key, "column").agg(F.avg("p").alias("p"))


def _numbered(keys: DataFrame, seed: int, key: str) -> DataFrame:
    """Keys in the order of a seeded hash, numbered from 1: ranges of the hash are counted first, so no task sorts all keys."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    rows = keys.select(key).distinct().withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("n"))  # 4,096 rows at most
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("n").over(Window.partitionBy()))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return rows.join(before.drop("n"), "_b").select(key, (inside + F.col("_before")).alias("position"), F.col("_n").alias("n"))


def kfold(keys: DataFrame, k: int, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """key, fold: blocks of a seeded order, the first n mod k of them one larger."""
    i, n = F.col("position") - 1, F.col("n")
    size, more = F.floor(n / k), n % k
    fold = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return _numbered(keys, seed, key).select(key, fold.cast("int").alias("fold"))


def holdout(keys: DataFrame, share: float, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """key, is_validation: the first max(1, round(n * share)) of a seeded order."""
    return _numbered(keys, seed, key).select(key, (F.col("position") <= F.greatest(F.lit(1), F.bround(F.col("n") * share))).alias("is_validation"))


def complete(required: DataFrame, predictions: DataFrame, columns: list[str], fill: float = 0.5, key: str = "doc_id") -> DataFrame:
    """A row for each required key: every column between 0 and 1, `fill` where nothing is known."""
    wide = predictions.groupBy(key).pivot("column", columns).agg(F.first("p"))
    cells = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(F.col(f"`{c}`"), F.lit(None)), F.lit(fill)))).alias(c) for c in columns]
    return required.select(key).distinct().join(wide, key, "left").select(key, *cells)


def check_complete(output: DataFrame, required: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """The output itself if its header is the key and the columns in order, each required key has exactly one row, no other key has any, and every value lies between 0 and 1; an error that
    says what is wrong otherwise."""
    if output.columns != [key, *columns]:
        raise ValueError(f"columns are {output.columns}, not {[key, *columns]}")
    outside = [F.count_if(F.coalesce(~F.col(f"`{c}`").between(0.0, 1.0) | F.isnan(f"`{c}`"), F.lit(True))).alias(f"bad {c}") for c in columns]
    n, keys, *bad = output.agg(F.count("*"), F.count_distinct(key), *outside).first()
    need = required.select(key).distinct()
    missing, extra = need.join(output, key, "left_anti").count(), output.join(need, key, "left_anti").count()
    faults = [f"{k} {what}" for k, what in ((n - keys, "repeated or null keys"), (missing, "keys without a row"), (extra, "keys that aren't required"), *zip(bad, [f"values of {c} outside 0..1" for c in columns], strict=True)) if k]
    if faults:
        raise ValueError(", ".join(faults))
    return output
