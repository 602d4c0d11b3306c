"""Coverage, agreement and rank-based scores, all as aggregations over cells, or over ranges of a column's scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import sums_below


def coverage(labels: DataFrame) -> DataFrame:
    y = F.col("label")
    n = F.count_if(y.isNotNull())
    return labels.groupBy("column").agg(n.alias("labelled"), F.count_if(y == 1).alias("positive"), F.count_if(y == 0).alias("negative"), F.bround(n * 100.0 / F.greatest(F.count("*"), F.lit(1)), 1).alias("pct_of_corpus"))


def _scores() -> list[Column]:
    g, p = F.col("gold"), F.col("label")
    both = g.isNotNull() & p.isNotNull()
    return [
        F.count_if(g.isNotNull()).alias("n_gold"),
        F.count_if(p.isNotNull()).alias("n_pred"),
        F.count_if(both).alias("n_overlap"),
        F.count_if(g == 1).alias("n_gold_pos"),
        F.count_if(p == 1).alias("n_pred_pos"),
        F.try_divide(F.count_if(both & (g == p)).cast("double"), F.count_if(both)).alias("agreement"),
        F.try_divide(F.count_if((g == 1) & (p == 1)).cast("double"), F.count_if(both & (p == 1))).alias("precision"),
        F.try_divide(F.count_if((g == 1) & (p == 1)).cast("double"), F.count_if(both & (g == 1))).alias("recall"),
    ]


def scores(cells: DataFrame, *by: str) -> DataFrame:
    """Scores of label against gold, by column or any columns; undefined ratios are null."""
    return cells.groupBy(*(by or ("column",))).agg(*_scores())


def scores_by_language(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """By language and, with a null language, over all: keys, overlapping cells, weighted agreement."""
    both = F.col("gold").isNotNull() & F.col("label").isNotNull()
    out = cells.rollup("lang").agg(
        F.grouping("lang").alias("all_languages"), F.count_distinct(key).alias("n_studies"), F.count_if(both).alias("overlap_cells"),
        F.try_divide(F.count_if(both & (F.col("gold") == F.col("label"))).cast("double"), F.count_if(both)).alias("agreement"),
    )
    return out.withColumn("all_languages", F.col("all_languages").cast("int"))


def auc(cells: DataFrame, *by: str) -> DataFrame:
    """Mann-Whitney area of p for y by column; ties count half. Null unless both classes are there.

    Rows are first counted by (column, p), so tied rows never meet in a task; sums below a score run over ranges of scores."""
    by = by or ("column",)
    bins = cells.where("y IS NOT NULL AND p IS NOT NULL").groupBy(*by, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return sums_below(bins, list(by), "p", ["neg"]).groupBy(*by).agg((F.sum("pos") + F.sum("neg")).alias("n"), F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def bce_cells(cells: DataFrame) -> DataFrame:
    """Adds loss: each cell's weighted cross entropy of its logit x against y; 0 where the weight is 0, whatever y is."""
    x, w = F.col("x"), F.coalesce(F.col("w").cast("double"), F.lit(0.0))
    y = F.when(w > 0, F.coalesce(F.nanvl(F.col("y").cast("double"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return cells.withColumn("loss", w * (F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))))


def masked_bce(cells: DataFrame, *by: str) -> DataFrame:
    """Weighted cross entropy of logits x against y: sum over max(sum of weights, 1); y null counts as 0, with whatever weight it has."""
    x, y, w = F.col("x"), F.coalesce("y", F.lit(0.0)), F.col("w")
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    sums = [F.sum(w * loss).alias("loss_sum"), (F.sum(w * loss) / F.greatest(F.sum(w), F.lit(1.0))).alias("loss_mean")]
    return cells.groupBy(*by).agg(*sums) if by else cells.agg(*sums)


def spread(cells: DataFrame, least: float = 1e-3) -> DataFrame:
    """Predictions that have collapsed to a point."""
    return cells.groupBy("column").agg(F.stddev_pop("p").alias("std"), (F.stddev_pop("p") < least).alias("collapsed"))
