"""Images of a series: intensities clipped over the series, resizing, affine warps, smooth fields, and augmentation whose parameters are drawn once a series.

Images are rows of (height, width, pixels): bytes, one row of the image after the other. Spark deals the rows out; what runs inside a task is one batched gather or two
small matrix products for all images of one shape. A null image stays null.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import normal, percentiles, slice_dropout, uniform

#: Images of a batch inside a task, of some 500 kB at most before resizing.
IMAGES = 64
#: Bytes of rows that are worked on at once where images keep their size, and samples of small images that are worked on in one step.
WHOLE, SAMPLES = 1 << 22, 1 << 18


def map_images(rows: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str, whole: bool = False) -> DataFrame:
    """mapInArrow over at most IMAGES rows at a time, or with `whole` a batch of at most WHOLE bytes; f returns columns."""

    def run(batches):
        for b in batches:
            step = max(b.num_rows, 1) if whole and b.nbytes <= WHOLE else IMAGES
            for at in range(0, b.num_rows, step):
                yield pa.RecordBatch.from_pydict(f(b.slice(at, step)))

    return rows.mapInArrow(run, schema)


def _schema(rows: DataFrame, more: str = "") -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + more


def _shapes(b: pa.RecordBatch, image: str = "pixels") -> dict[tuple[int, int], list[int]]:
    """Row numbers by (height, width), null images left out."""
    out: dict[tuple[int, int], list[int]] = {}
    there = b.column(image).is_valid().to_pylist()
    for k, (h, w, ok) in enumerate(zip(b.column("height").to_pylist(), b.column("width").to_pylist(), there, strict=True)):
        if ok:
            out.setdefault((h, w), []).append(k)
    return out


def _stack(b: pa.RecordBatch, at: list[int], shape: tuple[int, int], image: str = "pixels") -> np.ndarray:
    return np.frombuffer(b"".join(b.column(image).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), *shape)


def _stretches(at: list[int], shape: tuple[int, int]) -> list[list[int]]:
    """Row numbers of images of one shape in stretches of at most SAMPLES samples, or of one image."""
    n = max(1, SAMPLES // max(1, shape[0] * shape[1]))
    return [at[k : k + n] for k in range(0, len(at), n)]


def _replaced(b: pa.RecordBatch, **columns) -> dict:
    return {n: b.column(n) for n in b.schema.names} | columns


# Resizing: each output sample is a weighted mean of the input samples under a filter, which widens with the scale when an image shrinks.


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(x))


def cubic(x: np.ndarray) -> np.ndarray:
    """Cubic convolution with a = -0.5."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, -0.5 * (((x - 5) * x + 8) * x - 4), 0.0))


@functools.lru_cache(64)
def resampling(n_in: int, n_out: int, kernel: Callable = triangle, radius: float = 1.0) -> np.ndarray:
    """n_out x n_in weights, rows summing to one; built once for each pair of sizes."""
    scale = n_in / n_out
    wide = max(scale, 1.0)
    center = (np.arange(n_out) + 0.5) * scale
    low = np.maximum((center - radius * wide + 0.5).astype(int), 0)
    high = np.minimum((center + radius * wide + 0.5).astype(int), n_in)
    k = np.arange(n_in)
    weights = kernel((k - center[:, None] + 0.5) / wide)
    weights[(k < low[:, None]) | (k >= high[:, None])] = 0.0
    return weights / weights.sum(1, keepdims=True)


#: Weights of bytes are whole multiples of 2**-22, and each pass rounds to bytes.
BITS = 22


def _byte_pass(images: np.ndarray, n_out: int) -> np.ndarray:
    """Resizes the last axis."""
    if images.shape[-1] == n_out:
        return images
    whole = np.floor(0.5 + resampling(images.shape[-1], n_out) * (1 << BITS))
    sums = images.astype(np.float64) @ whole.T  # exact, as sums stay below 2**31
    return np.clip((sums.astype(np.int64) + (1 << BITS - 1)) >> BITS, 0, 255).astype(np.uint8)


def resized(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """Images (n, h, w) by the triangle filter, rows first."""
    return _byte_pass(_byte_pass(images, width).swapaxes(1, 2), height).swapaxes(1, 2)


def resize(rows: DataFrame, size: int) -> DataFrame:
    """rows with square images of `size`."""

    def run(b: pa.RecordBatch) -> dict:
        out: list[bytes | None] = [None] * b.num_rows
        for shape, at in _shapes(b).items():
            for k, image in zip(at, resized(_stack(b, at, shape), size, size), strict=True):
                out[k] = image.tobytes()
        sizes = pa.array([size] * b.num_rows, pa.int32())
        return _replaced(b, height=sizes, width=sizes, pixels=pa.array(out, pa.binary()))

    return map_images(rows, run, _schema(rows))


# Warps: an output sample is read from the input at a * x + b * y + c, d * x + e * y + f.


def turn_matrix(size: Column, degrees: Column, scale: Column, right: Column, down: Column) -> Column:
    """The six numbers of a turn and a scaling about the middle of a square image and a shift, from output to input places; quarter turns are exact."""
    angle, c = F.radians(degrees), size / 2.0
    a, b = F.round(F.cos(angle), 15) / scale, F.round(F.sin(angle), 15) / scale
    return F.array(a, b, c - a * c - b * c + right, -b, a, c + b * c - a * c + down)


def warped(images: np.ndarray, matrix: list[float] | np.ndarray) -> np.ndarray:
    """Bilinear samples of images (n, h, w), truncated to bytes; 0 outside. The matrix is one for all images, or an array (n, 6)."""
    n, h, w = images.shape
    own = isinstance(matrix, np.ndarray)
    a, b, c, d, e, f = matrix.T[:, :, None, None] if own else matrix
    k = np.arange(n)[:, None, None] if own else slice(None)
    x, y = np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5)
    u, v = a * x + b * y + c, d * x + e * y + f
    inside = (u >= 0) & (u < w) & (v >= 0) & (v < h)
    u, v = u - 0.5, v - 0.5
    left, top = np.floor(u), np.floor(v)
    dx, dy = u - left, v - top
    left, top = left.astype(int), top.astype(int)
    x0, x1 = np.clip(left, 0, w - 1), np.clip(left + 1, 0, w - 1)
    y0, y1 = np.clip(top, 0, h - 1), np.clip(top + 1, 0, h - 1)
    src = images.astype(np.float64)
    upper = src[k, y0, x0] + (src[k, y0, x1] - src[k, y0, x0]) * dx
    lower = src[k, y1, x0] + (src[k, y1, x1] - src[k, y1, x0]) * dx
    lower = np.where((top + 1 >= 0) & (top + 1 < h), lower, upper)
    return np.where(inside, upper + (lower - upper) * dy, 0.0).astype(np.uint8)


def warp(rows: DataFrame, matrix: str = "matrix") -> DataFrame:
    """rows with images read through `matrix` (six numbers; null: as it is)."""
    return map_images(rows, lambda b: _replaced(b, pixels=pa.array(_moved(b, matrix), pa.binary())), _schema(rows), whole=True)


def _moved(b: pa.RecordBatch, matrix: str) -> list[bytes | None]:
    """A batch's images read through their matrices: small ones all in one step, of large ones those that share a matrix."""
    out = b.column("pixels").to_pylist()
    matrices = b.column(matrix).to_pylist()
    for shape, at in _shapes(b).items():
        at = [k for k in at if matrices[k] is not None]
        if shape[0] * shape[1] * 8 <= SAMPLES:
            moves = [(mine, np.array([matrices[k] for k in mine])) for mine in _stretches(at, shape)]
        else:
            by: dict[tuple, list[int]] = {}
            for k in at:
                by.setdefault(tuple(matrices[k]), []).append(k)
            moves = [(mine, list(m)) for m, mine in by.items()]
        for mine, m in moves:
            for k, image in zip(mine, warped(_stack(b, mine, shape), m), strict=True):
                out[k] = image.tobytes()
    return out


# Smooth fields

GRID = 4


def field(grid: np.ndarray, height: int, width: int, strength: float) -> np.ndarray:
    """1 plus strength times the cubic interpolation of a coarse grid, scaled so that its largest absolute value is 1."""
    smooth = resampling(GRID, height, cubic, 2.0) @ grid.reshape(GRID, GRID) @ resampling(GRID, width, cubic, 2.0).T
    top = np.abs(smooth).max()
    return 1.0 + strength * (smooth / top if top > 0 else smooth)


def bias_field(rows: DataFrame, strength: float, grid: str = "grid") -> DataFrame:
    """Adds field: an array of height * width factors from the row's 16 grid values; in rows, one after the other."""

    def run(b: pa.RecordBatch) -> dict:
        sizes = zip(b.column(grid).to_pylist(), b.column("height").to_pylist(), b.column("width").to_pylist(), strict=True)
        fields = [field(np.array(g), h, w, strength).ravel().tolist() for g, h, w in sizes]
        return _replaced(b, field=pa.array(fields, pa.list_(pa.float64())))

    return map_images(rows, run, _schema(rows, ", field array<double>"))


# Intensities of a series


def clip_series(slices: DataFrame, by: list[str], order: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """by, order, height, width, pixels (bytes) from slices with height, width and values (array of floats, null if unreadable).

    Values are clipped to percentiles of the whole series and mapped to 0..255; unreadable slices count as zeros in the shape of the first readable one, and a series without any is
    left out. If the percentiles are equal, each slice's own take their place, then its extremes; what is flat even then is 0. The percentiles come from counts of
    values, so no task holds a series' samples."""
    first = slices.where("values IS NOT NULL").groupBy(*by).agg(F.min_by(F.struct("height", "width"), order).alias("_shape"))
    shaped = slices.join(first, by).withColumns({"height": F.when(F.col("values").isNull(), F.col("_shape.height")).otherwise(F.col("height")), "width": F.when(F.col("values").isNull(), F.col("_shape.width")).otherwise(F.col("width"))}).select(*by, order, "height", "width", "values")

    def count(b: pa.RecordBatch) -> dict:
        of, values, n = [], [], []
        for k, (x, h, w) in enumerate(zip(b.column("values"), b.column("height").to_pylist(), b.column("width").to_pylist(), strict=True)):
            found, many = np.unique(x.values.to_numpy().astype(np.float64), return_counts=True) if x.is_valid else (np.zeros(1), np.array([h * w]))
            of.append(np.full(len(found), k))
            values.append(found)
            n.append(many)
        take = pa.array(np.concatenate(of))
        return {c: b.column(c).take(take) for c in by} | {"value": pa.array(np.concatenate(values)), "n": pa.array(np.concatenate(n).astype(np.int64))}

    kinds = dict(slices.dtypes)
    counts = map_images(shaped, count, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", value double, n bigint").groupBy(*by, "value").agg(F.sum("n").alias("n"))
    bounds = percentiles(counts, by, "value", "n", [low, high])

    def scale(b: pa.RecordBatch) -> dict:
        out = []
        for x, h, w, q in zip(b.column("values"), b.column("height").to_pylist(), b.column("width").to_pylist(), b.column("_q").to_pylist(), strict=True):
            v = x.values.to_numpy().astype(np.float64) if x.is_valid else np.zeros(h * w)
            for bounds_of in (lambda v, q=q: q, lambda v: np.percentile(v, [100 * low, 100 * high]), lambda v: (v.min(), v.max())):
                lo, hi = bounds_of(v)
                if hi > lo:
                    out.append(np.rint((np.clip(v, lo, hi) - lo) / (hi - lo) * 255).astype(np.uint8).tobytes())
                    break
            else:
                out.append(bytes(h * w))
        return {c: b.column(c) for c in (*by, order, "height", "width")} | {"pixels": pa.array(out, pa.binary())}

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, order)) + ", height int, width int, pixels binary"
    return map_images(shaped.join(bounds, by), scale, schema)


# Augmentation


@dataclass(frozen=True)
class Augment:
    """Ranges that a series' parameters are drawn from: gamma; shares of full scale (brightness, noise), of the contrast about the mean, of the smooth field; degrees; scale; shift by shares of
    the side; the share of blank slices. `p` is the chance that a series changes at all."""

    p: float = 0.8
    gamma: tuple[float, float] = (0.7, 1.45)
    brightness: float = 0.15
    contrast: float = 0.20
    noise: float = 0.025
    field: float = 0.20
    degrees: float = 8.0
    scale: float = 0.10
    shift: float = 0.06
    dropout: float = 0.10

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Augment:
        return cls(**{k: tuple(v) if k == "gamma" else float(v) for k, v in d.items()})


def draws(series: DataFrame, by: list[str], config: Augment, seed: int, epoch: int) -> DataFrame:
    """by, applied, degrees, scale, right and down (in sides), gamma, contrast, brightness, grid: the same for each (seed, epoch, series), however rows are dealt out."""
    part = lambda name: uniform(F.lit(f"{seed}:{epoch}"), *[F.col(c) for c in by], F.lit(name))
    spread = lambda name, most: (2 * part(name) - 1) * most
    low, high = config.gamma
    grid = F.array(*[normal(F.lit(f"{seed}:{epoch}"), *[F.col(c) for c in by], F.lit(f"grid{k}")) for k in range(GRID * GRID)])
    drawn = {
        "applied": part("applied") <= config.p, "degrees": spread("degrees", config.degrees), "scale": 1 + spread("scale", config.scale), "right": spread("right", config.shift), "down": spread("down", config.shift),
        "gamma": low + part("gamma") * (high - low), "contrast": 1 + spread("contrast", config.contrast), "brightness": spread("brightness", config.brightness), "grid": grid,
    }
    return series.select(*by).distinct().withColumns(drawn)


def augment(slices: DataFrame, by: list[str], order: str, config: Augment, seed: int, epoch: int) -> DataFrame:
    """by, order, height, width, pixels: slices after the warp (square images only), gamma, contrast about the series' mean, brightness, the smooth field, noise and blank slices, all with
    parameters that are drawn once a series; truncated to bytes. Series that aren't drawn stay as they are. Noise is drawn by slice, so that it doesn't depend on how rows are
    dealt out either."""
    key = [F.col(c) for c in by]
    # what is drawn comes before the images are worked on, so that no image is worked on twice; few files would make few tasks
    parts = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = slices.select(*by, order, "height", "width", "pixels").repartition(parts, *by)
    rows = slice_dropout(rows, by, order, config.dropout, f"{seed}:{epoch}:dropout").join(draws(slices, by, config, seed, epoch), by)
    side = F.col("width")
    geometry = F.when(F.col("applied") & (F.col("height") == side), turn_matrix(side, F.col("degrees"), F.col("scale"), F.col("right") * side, F.col("down") * side))
    rows = rows.withColumn("matrix", geometry).drop("degrees", "scale", "right", "down")

    def bent(b: pa.RecordBatch, at: list[int], shape: tuple[int, int]) -> np.ndarray:
        return (_stack(b, at, shape) / 255.0) ** _numbers(b, "gamma", at)

    def bend(b: pa.RecordBatch) -> dict:
        b = pa.RecordBatch.from_pydict(_replaced(b, pixels=pa.array(_moved(b, "matrix"), pa.binary())))
        total, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
        for shape, at in _shapes(b).items():
            n[at] = shape[0] * shape[1]
            for mine in _stretches(at, shape):
                total[mine] = bent(b, mine, shape).reshape(len(mine), -1).sum(1)
        return _replaced(b, bent=pa.array(total), n=pa.array(n))

    rows = map_images(rows, bend, _schema(rows, ", bent double, n bigint"), whole=True).drop("matrix")
    whole = Window.partitionBy(*by)  # the slices of one series
    rows = rows.withColumn("mean", F.sum("bent").over(whole) / F.sum("n").over(whole)).drop("bent", "n")
    rows = rows.withColumn("noise", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{epoch}:noise"), *key, F.col(order))), 1, 15), 16, 10).cast("bigint"))

    def change(b: pa.RecordBatch) -> dict:
        out, applied = b.column("pixels").to_pylist(), b.column("applied").to_pylist()
        kept, keys, grids = (b.column(c).to_pylist() for c in ("kept", "noise", "grid"))
        for shape, at in _shapes(b).items():
            fields: dict[tuple, np.ndarray] = {}
            for mine in _stretches([k for k in at if applied[k]], shape):
                factors = []
                for k in mine:
                    g = tuple(grids[k])
                    if g not in fields:
                        if len(fields) * shape[0] * shape[1] > SAMPLES:
                            fields.clear()
                        fields[g] = field(np.array(g), *shape, config.field)
                    factors.append(fields[g])
                mean, contrast, brightness = (_numbers(b, c, mine) for c in ("mean", "contrast", "brightness"))
                x = ((bent(b, mine, shape) - mean) * contrast + mean + brightness) * np.stack(factors)
                for j, k in enumerate(mine):
                    if not kept[k]:
                        x[j] = 0.0
                    elif config.noise:
                        x[j] += np.random.Generator(np.random.Philox(key=keys[k])).normal(0.0, config.noise, shape)
                for k, image in zip(mine, (np.clip(x, 0.0, 1.0) * 255.0).astype(np.uint8), strict=True):
                    out[k] = image.tobytes()
        return {c: b.column(c) for c in (*by, order, "height", "width")} | {"pixels": pa.array(out, pa.binary())}

    return map_images(rows, change, _schema(slices.select(*by, order, "height", "width", "pixels")), whole=True)


def _numbers(b: pa.RecordBatch, column: str, at: list[int]) -> np.ndarray:
    """Numbers of rows, a row an image."""
    return b.column(column).to_numpy(zero_copy_only=False)[at][:, None, None]
