"""Label algebra on cells (key, column, label): precedence, weights, agreement of two labelers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confidence_weight(precision: Column) -> Column:
    """0 for a coin's precision, 1 for a perfect one."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (precision - 0.5) * 2))


def balance_factor(rate: Column) -> Column:
    """4p(1-p), p between 0 and 1: 1 for balanced labels, 0 for labels of one kind."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate))
    return 4 * p * (1 - p)


def column_weights(labels: DataFrame, precision: DataFrame) -> DataFrame:
    """column, weight: confidence times balance. precision: a row (column, precision) for each column, so its side is as small as the set of columns."""
    rates = labels.where("label IS NOT NULL").groupBy("column").agg(F.avg("label").alias("rate"))
    return rates.join(precision, "column").select("column", (confidence_weight(F.col("precision")) * balance_factor(F.col("rate"))).alias("weight"))


def build_targets(cells: DataFrame, pseudo: DataFrame, gold: DataFrame, weights: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, column, label, weight, is_gold of every cell: the gold label if there is one, else the pseudo label. Weight 0 without a label, 1 for gold, else the column's (1 if it has none)."""
    out = cells.select(key, "column").join(pseudo.select(key, "column", F.col("label").alias("_p")), [key, "column"], "left").join(gold.select(key, "column", F.col("label").alias("_g")), [key, "column"], "left")
    if weights is not None:
        out = out.join(weights.select("column", F.col("weight").alias("_w")), "column", "left")
    else:
        out = out.withColumn("_w", F.lit(1.0))
    label = F.coalesce("_g", "_p")
    weight = F.when(label.isNull(), 0.0).when(F.col("_g").isNotNull(), 1.0).otherwise(F.coalesce("_w", F.lit(1.0)))
    return out.select(key, "column", label.alias("label"), weight.alias("weight"), F.col("_g").isNotNull().alias("is_gold"))


def gold_only(targets: DataFrame) -> DataFrame:
    """Weights of cells without gold become 0."""
    return targets.withColumn("weight", F.when(F.col("is_gold"), F.col("weight")).otherwise(0.0))


def trainable(targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys with a cell of weight above 0."""
    return targets.groupBy(key).agg(F.max("weight").alias("w")).where("w > 0").select(key)


def combine(a: DataFrame, b: DataFrame, prefer: str | None = None, agree: float = 1.0, only_a: float = 0.6, only_b: float = 0.6, conflict: float = 0.0, key: str = "doc_id") -> DataFrame:
    """key, column, label, weight, provenance of all cells that either labeler knows. A conflict has no label unless one side is preferred."""
    both = a.select(key, "column", F.col("label").alias("_a")).join(b.select(key, "column", F.col("label").alias("_b")), [key, "column"], "full_outer")
    x, y = F.col("_a"), F.col("_b")
    kind = F.when(x.isNull() & y.isNull(), "none").when(y.isNull(), "only_a").when(x.isNull(), "only_b").when(x == y, "agree").otherwise("conflict")
    chosen = {"a": x, "b": y}.get(prefer or "", F.lit(None).cast("double"))
    label = F.when(kind == "conflict", chosen).otherwise(F.coalesce(x, y))
    weight = F.when(kind == "agree", agree).when(kind == "only_a", only_a).when(kind == "only_b", only_b).when(kind == "conflict", conflict).otherwise(0.0)
    return both.select(key, "column", label.alias("label"), F.when(label.isNull(), 0.0).otherwise(weight).alias("weight"), kind.alias("provenance"))


PROVENANCES = ["agree", "only_a", "only_b", "conflict", "none"]


def provenance_summary(combined: DataFrame) -> DataFrame:
    return combined.groupBy("column").agg(*[F.count_if(F.col("provenance") == p).alias(p) for p in PROVENANCES])


def accuracy_by_provenance(combined: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """Always four rows; accuracy is null where no labelled cell has gold."""
    cells = combined.join(gold.where("label IS NOT NULL").select(key, "column", F.col("label").alias("_g")), [key, "column"]).where("label IS NOT NULL")
    found = cells.groupBy("provenance").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("_g")).cast("double")).alias("accuracy"))
    kinds = combined.sparkSession.createDataFrame([(p,) for p in PROVENANCES[:4]], "provenance string")
    return kinds.join(found, "provenance", "left").select("provenance", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


def any_label(wide: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a wide table with at least one label."""
    return wide.where(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in columns]))


def labelled_cells(targets: DataFrame) -> DataFrame:
    """labelled, cells: how many cells of a table of targets have a label to learn from, of how many."""
    return targets.agg(F.count_if(F.col("weight") > 0).alias("labelled"), F.count("*").alias("cells"))


def missing_targets(found: list[str], expected: list[str]) -> list[str]:
    """The expected target columns that a table lacks, in their order."""
    return [c for c in expected if c not in set(found)]


def first_seen(*parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, part: each key of several tables once, with the number of the first table that has it."""
    rows = [p.select(key, F.lit(k).alias("part")) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, rows).groupBy(key).agg(F.min("part").alias("part"))


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """A sample: the first n rows in order. Each task keeps n at most."""
    return rows.orderBy(*order).limit(n)
