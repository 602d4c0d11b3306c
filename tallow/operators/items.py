"""Volumes of studies, and training items from them in the order of an epoch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .heads import PLANES
from .pixels import clip_series, map_images, resize
from .series import sample_indices, slots, uniform, window_indices


def sampled(slices: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """n slices of each series, evenly spaced in order: adds position (0 to n - 1); a short series repeats slices. Slices are put in order series by series."""
    whole = Window.partitionBy(*by)
    placed = slices.withColumns({"_at": F.row_number().over(whole.orderBy(*order)) - 1, "_n": F.count("*").over(whole).cast("int")})
    taken = placed.withColumn("_p", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(sample_indices(F.col("_n"), n), k) == F.col("_at"))))
    return taken.drop("_at", "_n").withColumnRenamed("_p", "position")


def volumes(slices: DataFrame, selected: DataFrame, n: int, size: int, most: int, order: list[str], target: str = "R", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """study, slot, uid, mask, plane, side, pixels (n x size x size bytes, slice after slice): always `most` slots a study.

    slices: study, uid, plane, side, height, width, values, and the columns of `order`. selected: study, uids. Slices are sampled, clipped over the series, resized, and mirrored to the target side where
    the side is known. A slot without a readable series has mask = false, no uid, an unknown plane and zeros. A series' n sampled slices meet in one row."""
    kept = slots(selected, most)
    ordered = [f"_o{k}" for k in range(len(order))]
    needed = slices.select("study", "uid", "plane", "side", "height", "width", "values", *[F.col(c).alias(o) for c, o in zip(order, ordered, strict=True)])
    rows = sampled(needed.join(kept.where("mask").select("study", "uid"), ["study", "uid"], "left_semi"), ["study", "uid"], ordered, n)
    about = rows.groupBy("study", "uid").agg(F.min("plane").alias("plane"), F.min("side").alias("side"))
    images = resize(clip_series(rows.select("study", "uid", "position", "height", "width", "values"), ["study", "uid"], "position", low, high), size)
    stacks = images.groupBy("study", "uid").agg(F.array_sort(F.collect_list(F.struct("position", "pixels"))).alias("s")).join(about, ["study", "uid"])

    def stack(b: pa.RecordBatch) -> dict:
        out = []
        for s, plane, side in zip(b.column("s"), b.column("plane").to_pylist(), b.column("side").to_pylist(), strict=True):
            x = np.stack([np.frombuffer(v, np.uint8).reshape(size, size) for v in s.values.field("pixels").to_pylist()])
            out.append(mirrored(x, plane, side, target).tobytes())
        return {c: b.column(c) for c in ("study", "uid", "plane", "side")} | {"pixels": pa.array(out, pa.binary())}

    kinds = dict(stacks.dtypes)
    whole = map_images(stacks, stack, f"study {kinds['study']}, uid {kinds['uid']}, plane string, side string, pixels binary")
    out = kept.drop("mask").join(whole, ["study", "uid"], "left")
    there = F.col("pixels").isNotNull()
    blank = F.unhex(F.repeat(F.lit("00"), n * size * size))
    return out.select("study", "slot", F.when(there, F.col("uid")).alias("uid"), there.alias("mask"), F.when(there & F.col("plane").isin(*PLANES), F.col("plane")).otherwise(PLANES[0]).alias("plane"), "side", F.coalesce("pixels", blank).alias("pixels"))


def mirrored(volume: np.ndarray, plane: str | None, side: str | None, target: str = "R") -> np.ndarray:
    """Slices in reverse order for the other side's sagittal series, mirrored images for its coronal and axial ones; the rest as it is."""
    if side is None or side == target:
        return volume
    return volume[::-1] if plane == "sagittal" else volume[:, :, ::-1] if plane in ("coronal", "axial") else volume


def epoch_order(seed: int, epoch: int, key: str = "study") -> Column:
    """A number that puts keys in an order of their own for each seed and epoch."""
    return uniform(F.lit(f"{seed}:{epoch}:order"), F.col(key))


def training_items(wanted: DataFrame, stored: DataFrame, targets: DataFrame, columns: list[str], pool: int, n: int, size: int, seed: int, epoch: int, shards: int, offset: float = 0.0, jitter: float = 0.0) -> DataFrame:
    """shard, at, study, pixels (an array of slots, each n x size x size bytes), series_mask, planes, y, mask: one row a study, in `shards` ranges of the epoch's order and sorted in them, so that a
    loader reads one file after the other.

    wanted: study. stored: volumes with `pool` slices. targets: study, column, label, weight. n slices are taken from the pool at `offset` (in spacings), each moved by a drawn share of `jitter` at
    most. A missing label is 0 with a mask of 0, whatever its weight. Studies without a volume are left out; if none has one, that is an error."""
    rows = wanted.select("study").distinct().join(stored, "study")
    if rows.isEmpty():
        raise ValueError("none of the studies has a volume")
    per = rows.groupBy("study").agg(F.array_sort(F.collect_list(F.struct("slot", "mask", "plane", "pixels"))).alias("v"))  # a few slots
    named = targets.where(F.col("column").isin(columns))
    known = F.col("label").isNotNull() & ~F.isnan(F.col("label").cast("double"))
    last = lambda c, v: F.coalesce(F.max(F.when((F.col("column") == c) & known, F.col(v).cast("double"))), F.lit(0.0))
    wide = named.groupBy("study").agg(F.array(*[last(c, "label") for c in columns]).alias("y"), F.array(*[last(c, "weight") for c in columns]).alias("mask"))
    nothing = F.array_repeat(F.lit(0.0), len(columns))
    per = per.join(wide, "study", "left").withColumns({"y": F.coalesce("y", nothing), "mask": F.coalesce("mask", nothing), "at": epoch_order(seed, epoch)})
    moved = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (2 * uniform(F.lit(f"{seed}:{epoch}:jitter"), F.col("study"), k) - 1) * jitter)
    spacing = float(pool - 1) / max(n - 1, 1)
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.greatest(F.lit(0), F.least(F.lit(pool - 1), F.bround((k + F.lit(offset) + F.get(F.col("_moved"), k)) * F.lit(spacing)).cast("int"))).cast("int"))
    taken = per.withColumn("_moved", moved).withColumn("_taken", own if jitter else window_indices(F.lit(pool), n, offset))
    each = size * size
    cut = F.transform("v", lambda s: F.unhex(F.array_join(F.transform("_taken", lambda i: F.substring(F.hex(s["pixels"]), i * 2 * each + 1, F.lit(2 * each))), "")))
    code = lambda p: F.coalesce(*[F.when(p == name, F.lit(k)) for k, name in enumerate(PLANES)], F.lit(0))
    out = taken.select(F.floor(F.col("at") * shards).cast("int").alias("shard"), "at", "study", cut.alias("pixels"), F.transform("v", lambda s: s["mask"]).alias("series_mask"), F.transform("v", lambda s: code(s["plane"])).alias("planes"), "y", "mask")
    return out.repartitionByRange(shards, "at").sortWithinPartitions("at", "study")


def write_epoch(items: DataFrame, path: str) -> None:
    """A file a shard: tasks hold a range of the order each, and their files' numbers follow it."""
    items.write.mode("overwrite").parquet(path)
