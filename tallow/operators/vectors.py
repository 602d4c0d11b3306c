"""Gated attention pooling of stored vectors: sums over vectors of a bag, never a bag in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import window_indices


def dot(x: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def gate(x: Column, v: list[list[float]], u: list[list[float]], w: list[float]) -> Column:
    """The attention score: w of tanh(Vx) times sigmoid(Ux)."""
    out = F.lit(0.0)
    for vk, uk, wk in zip(v, u, w, strict=True):
        out = out + F.lit(float(wk)) * F.tanh(dot(x, vk)) * (1 / (1 + F.exp(-dot(x, uk))))
    return out


def attention_pool(rows: DataFrame, bag: str, x: str, score: Column, mask: Column | None = None) -> DataFrame:
    """bag, dim, value: the softmax-weighted mean of the bag's vectors; masked ones weigh nothing, a bag of masked ones only has no rows."""
    kept = rows.where(mask) if mask is not None else rows
    scored = kept.select(bag, F.col(x).alias("_x"), score.alias("_s"))
    tops = scored.groupBy(bag).agg(F.max("_s").alias("_top"))
    weighed = scored.join(tops, bag).withColumn("_e", F.exp(F.col("_s") - F.col("_top")))
    parts = weighed.select(bag, "_e", F.posexplode("_x").alias("dim", "_v")).groupBy(bag, "dim").agg((F.sum(F.col("_e") * F.col("_v")) / F.sum("_e")).alias("value"))
    return parts


def two_level_pool(slices: DataFrame, study: str, series: str, x: str, slice_score: Callable[[Column], Column], series_score: Callable[[Column], Column], plane: str | None = None, embedding: DataFrame | None = None, mask: Column | None = None) -> DataFrame:
    """study, dim, value: slices are pooled to series, a vector for its plane is added to each series' (embedding: plane, dim, add; a row for each plane and dimension), and
    series are pooled to studies."""
    kinds = [plane] if plane and embedding is not None else []
    kept = (slices.where(mask) if mask is not None else slices).withColumn("_bag", F.struct(study, series, *kinds))
    rows = attention_pool(kept, "_bag", x, slice_score(F.col(x)))
    if kinds:
        # a few planes
        rows = rows.withColumn("plane", F.col(f"_bag.{plane}")).join(F.broadcast(embedding), ["plane", "dim"], "left").withColumn("value", F.col("value") + F.coalesce("add", F.lit(0.0)))
    # a series' vector is some hundred numbers
    vectors = rows.groupBy("_bag").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v"))
    vectors = vectors.select(F.col(f"_bag.{study}").alias(study), F.transform("v", lambda e: e["value"]).alias("_x"))
    return attention_pool(vectors, study, "_x", series_score(F.col("_x")))


def linear_head(pooled: DataFrame, key: str, weights: dict[str, list[float]], bias: dict[str, float]) -> DataFrame:
    """key, column, p: the sigmoid of each column's weighted sum over the pooled vector (key, dim, value)."""
    w = F.array(*[F.array(*map(F.lit, v)) for v in weights.values()])
    sums = [F.sum(F.col("value") * F.get(F.get(w, F.lit(k)), F.col("dim"))) + F.lit(float(bias.get(c, 0.0))) for k, c in enumerate(weights)]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_z{k}").alias("z")) for k, c in enumerate(weights)])
    wide = pooled.groupBy(key).agg(*[z.alias(f"_z{k}") for k, z in enumerate(sums)])
    return wide.select(key, F.explode(cells).alias("c")).select(key, "c.column", (1 / (1 + F.exp(-F.col("c.z")))).alias("p"))


def offset_average(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean probability over test-time offsets."""
    return cells.groupBy(key, "column").agg((F.sum("p") / F.count_distinct("offset")).alias("p"))


def window_scores(slices: DataFrame, study: str, series: str, order: list[str], x: str, n: int, offsets: list[float], slice_score: Callable[[Column], Column], series_score: Callable[[Column], Column], weights: dict[str, list[float]], bias: dict[str, float], plane: str | None = None, embedding: DataFrame | None = None) -> DataFrame:
    """study, column, p: the mean probability over windows of n slices at each offset (in spacings), all from one read. Each slice's attention score is worked out once; then a slice goes to every
    window that takes it, as often as it is taken, and windows are pooled and scored side by side. A series' slices are put in order in one task."""
    whole = Window.partitionBy(study, series)
    kinds = [plane] if plane else []
    placed = slices.select(study, series, *kinds, x, *[c for c in order if c not in (study, series, plane, x)], slice_score(F.col(x)).alias("_score"))
    placed = placed.withColumns({"_at": F.row_number().over(whole.orderBy(*order)) - 1, "_n": F.count("*").over(whole).cast("int")})
    taken = [F.struct(F.lit(float(o)).alias("offset"), F.size(F.filter(window_indices(F.col("_n"), n, o), lambda i: i == F.col("_at"))).alias("times")) for o in offsets]
    dealt = placed.withColumn("_w", F.explode(F.array(*taken))).where("_w.times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_w.times"))))
    dealt = dealt.withColumn("_key", F.struct(F.col(study).alias("study"), F.col("_w.offset").alias("offset"))).drop("_w", "_copy", study, "_at", "_n")
    pooled = two_level_pool(dealt, "_key", series, x, lambda _: F.col("_score"), series_score, plane, embedding)
    cells = linear_head(pooled, "_key", weights, bias)
    return offset_average(cells.select(F.col("_key.study").alias(study), F.col("_key.offset").alias("offset"), "column", "p"), study)
