"""Images against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallow.operators import pixels

RNG = np.random.default_rng(5)


def plain_pass(row, n_out):
    """One line of bytes, resized by the widened triangle with weights in steps of 2**-22."""
    n_in = len(row)
    if n_in == n_out:
        return list(row)
    scale = n_in / n_out
    wide, out = max(scale, 1.0), []
    for i in range(n_out):
        center = (i + 0.5) * scale
        ks = range(max(0, int(center - wide + 0.5)), min(n_in, int(center + wide + 0.5)))
        w = [max(0.0, 1 - abs((k - center + 0.5) / wide)) for k in ks]
        total = sum(w)
        out.append(min(255, (sum(int(row[k]) * int(0.5 + x / total * 2**22) for k, x in zip(ks, w, strict=True)) + 2**21) >> 22))
    return out


@pytest.mark.parametrize("shape,to", [((5, 7), (3, 3)), ((4, 4), (9, 9)), ((3, 8), (6, 6)), ((6, 6), (6, 6)), ((1, 1), (4, 4)), ((30, 17), (8, 8)), ((6, 3), (6, 6))])
def test_resize(shape, to):
    image = RNG.integers(0, 256, shape).astype(np.uint8)
    wide = [plain_pass(row, to[1]) for row in image]
    want = np.array([plain_pass(column, to[0]) for column in zip(*wide, strict=True)]).T
    assert (pixels.resized(image[None], *to)[0] == want).all()


def plain_warp(image, m):
    h, w = image.shape
    out = np.zeros((h, w), dtype=np.uint8)
    for y in range(h):
        for x in range(w):
            u, v = m[0] * (x + 0.5) + m[1] * (y + 0.5) + m[2], m[3] * (x + 0.5) + m[4] * (y + 0.5) + m[5]
            if not (0 <= u < w and 0 <= v < h):
                continue
            u, v = u - 0.5, v - 0.5
            l, t = math.floor(u), math.floor(v)
            at = lambda yy, xx: float(image[min(max(yy, 0), h - 1), min(max(xx, 0), w - 1)])
            line = lambda yy, l=l, u=u: at(yy, l) + (at(yy, l + 1) - at(yy, l)) * (u - l)
            out[y, x] = int(line(t) + (line(t + 1) - line(t)) * (v - t))
    return out


def matrix(spark, size, *args):
    return spark.range(1).select(pixels.turn_matrix(F.lit(size), *map(F.lit, args)).alias("m")).first().m


def test_warp(spark):
    for shape in ((5, 5), (4, 7)):
        image = RNG.integers(0, 256, shape).astype(np.uint8)
        for m in ([1, 0, 0, 0, 1, 0], [1, 0, 0.3, 0, 1, -1.2], [0.9, 0.3, -0.4, -0.2, 1.1, 0.7], [2.0, 0, -3, 0, 0.4, 1]):
            assert (pixels.warped(image[None], m)[0] == plain_warp(image, m)).all()
    for size in (4, 5):
        image = RNG.integers(0, 256, (size, size)).astype(np.uint8)
        assert (pixels.warped(image[None], matrix(spark, size, 0.0, 1.0, 0.0, 0.0))[0] == image).all()
        for turns in (1, 2, 3):
            assert (pixels.warped(image[None], matrix(spark, size, 90.0 * turns, 1.0, 0.0, 0.0))[0] == np.rot90(image, -turns)).all()
        moved = pixels.warped(image[None], matrix(spark, size, 0.0, 1.0, 1.0, 0.0))[0]
        assert (moved[:, :-1] == image[:, 1:]).all() and (moved[:, -1] == 0).all()


def test_field():
    grid = RNG.normal(size=16)
    f = pixels.field(grid, 9, 12, 0.2)
    assert abs(np.abs(f - 1).max() - 0.2) < 1e-12
    assert (pixels.field(np.zeros(16), 3, 3, 0.2) == 1).all() and np.allclose(pixels.field(np.ones(16), 8, 8, 0.2), 1.2)
    assert np.allclose(pixels.resampling(4, 4, pixels.cubic, 2.0), np.eye(4))


def rows_of(spark, images, series=lambda k: k % 3):
    data = [(series(k), k, x.shape[0], x.shape[1], bytearray(x.tobytes())) if x is not None else (series(k), k, 4, 4, None) for k, x in enumerate(images)]
    return spark.createDataFrame(data, "series long, slice long, height int, width int, pixels binary")


def test_shapes_and_nulls(spark):
    images = [RNG.integers(0, 256, s).astype(np.uint8) for s in ((4, 4), (6, 3), (4, 4))] + [None]
    rows = rows_of(spark, images)
    got = {r.slice: r for r in pixels.resize(rows, 5).collect()}
    assert got[3].pixels is None and all(bytes(got[k].pixels) == pixels.resized(images[k][None], 5, 5)[0].tobytes() and got[k].height == 5 for k in range(3))
    out = pixels.warp(rows.withColumn("matrix", F.when(F.col("slice") != 2, F.array(*map(F.lit, [1.0, 0.0, 0.5, 0.0, 1.0, 0.25]))))).collect()
    got = {r.slice: r.pixels for r in out}
    assert got[3] is None and bytes(got[2]) == images[2].tobytes() and bytes(got[1]) == plain_warp(images[1], [1, 0, 0.5, 0, 1, 0.25]).tobytes()
    assert pixels.resize(rows.limit(0), 5).count() == 0


def test_clip_in_the_flat_cases(spark):
    nan = None
    series = {"usual": [[0.0, 1.0, 2.0, 50.0], [3.0, 4.0, 5.0, 6.0]], "blank": [nan, [7.0, 7.0, 7.0, 7.0]], "none": [nan, nan], "flat": [[3.0] * 4, [3.0] * 4]}
    rows = [(s, k, 2, 2, v) for s, vs in series.items() for k, v in enumerate(vs)]
    # most of a series is one value, so that its percentiles are equal, but one slice has another
    rows += [("rare", k, 10, 10, [1.0] * 100) for k in range(9)] + [("rare", 9, 10, 10, [1.0] * 99 + [5.0])]
    out = {(r.series, r.slice): list(r.pixels) for r in pixels.clip_series(spark.createDataFrame(rows, "series string, slice int, height int, width int, values array<float>"), ["series"], "slice").collect()}
    every = np.array(series["usual"]).ravel()
    lo, hi = np.percentile(every, [1, 99])
    assert [*out["usual", 0], *out["usual", 1]] == np.rint((np.clip(every, lo, hi) - lo) / (hi - lo) * 255).astype(int).tolist()
    assert out["blank", 0] == [0] * 4 and out["blank", 1] == [255] * 4
    assert ("none", 0) not in out and out["flat", 1] == [0] * 4
    lo, hi = np.percentile([1.0] * 99 + [5.0], [1, 99])
    assert out["rare", 3] == [0] * 100 and out["rare", 9] == [0] * 99 + [255] and hi > lo


def plain_augment(images, d, config, kept, noise):
    """Slices of one series, one step after the other."""
    if not d.applied:
        return images
    size = images[0].shape[1]
    a, c = math.radians(d.degrees), size / 2
    p, q = round(math.cos(a), 15) / d.scale, round(math.sin(a), 15) / d.scale
    m = [p, q, c - p * c - q * c + d.right * size, -q, p, c + q * c - p * c + d.down * size]
    bent = [(plain_warp(x, m) / 255.0) ** d.gamma for x in images]
    mean = sum(x.sum() for x in bent) / sum(x.size for x in bent)
    out = []
    for x, stays, key in zip(bent, kept, noise, strict=True):
        x = ((x - mean) * d.contrast + mean + d.brightness) * pixels.field(np.array(d.grid), size, size, config.field)
        x = x + np.random.Generator(np.random.Philox(key=key)).normal(0, config.noise, x.shape) if stays else np.zeros_like(x)
        out.append((np.clip(x, 0, 1) * 255).astype(np.uint8))
    return out


def test_augment(spark):
    import hashlib

    from tallow.operators.series import slice_dropout

    images = [RNG.integers(0, 256, (5, 5)).astype(np.uint8) for _ in range(60)]
    rows = rows_of(spark, images, lambda k: k % 12)
    config = pixels.Augment(dropout=0.3)
    assert pixels.Augment.from_dict(config.to_dict()) == config
    one = {r.slice: bytes(r.pixels) for r in pixels.augment(rows.repartition(1), ["series"], "slice", config, 3, 1).collect()}
    many = {r.slice: bytes(r.pixels) for r in pixels.augment(rows.repartition(7), ["series"], "slice", config, 3, 1).collect()}
    assert one == many
    other = {r.slice: bytes(r.pixels) for r in pixels.augment(rows, ["series"], "slice", config, 3, 2).collect()}
    assert other != one
    drawn = {r.series: r for r in pixels.draws(rows, ["series"], config, 3, 1).collect()}
    kept = {r.slice: r.kept for r in slice_dropout(rows, ["series"], "slice", 0.3, "3:1:dropout").collect()}
    assert {d.applied for d in drawn.values()} == {True, False} and not all(kept.values())
    for s, d in drawn.items():
        mine = [k for k in range(60) if k % 12 == s]
        noise = [int(hashlib.md5(f"3:1:noise:{s}:{k}".encode()).hexdigest()[:15], 16) for k in mine]
        want = plain_augment([images[k] for k in mine], d, config, [kept[k] for k in mine], noise)
        for k, x in zip(mine, want, strict=True):
            got = np.frombuffer(one[k], np.uint8).astype(int)
            assert np.abs(got - x.ravel().astype(int)).max() <= 1 and (got == x.ravel()).mean() > 0.99
    off = pixels.augment(rows, ["series"], "slice", pixels.Augment(p=-1.0), 3, 1)
    assert {r.slice: bytes(r.pixels) for r in off.collect()} == {k: x.tobytes() for k, x in enumerate(images)}


def test_clip_to_the_last_bit_of_a_percentile(spark):
    """The middle value's level is 128 by the SQL's percentiles, 127 if they are off by a bit."""
    rows = spark.createDataFrame([("s", 0, 1, 3, [6.5, 7.5, 8.5])], "series string, slice int, height int, width int, values array<float>")
    assert list(pixels.clip_series(rows, ["series"], "slice").first().pixels) == [0, 128, 255]


def test_small_and_large_images_by_their_own_matrices(spark):
    """Images of a batch are read each through its own matrix, small ones in one step."""
    sizes = [(5, 5), (5, 5), (200, 180), (5, 5), (200, 180), (3, 7)]
    images = [RNG.integers(0, 256, s).astype(np.uint8) for s in sizes]
    matrices = [[0.9, 0.1 * k, -0.4, -0.2, 1.1, 0.3 * k] for k in range(5)] + [None]
    both = pixels.warped(np.stack([images[0], images[1]]), np.array(matrices[:2]))
    assert all((both[k] == plain_warp(images[k], matrices[k])).all() for k in (0, 1))
    rows = rows_of(spark, images).coalesce(1).join(F.broadcast(spark.createDataFrame(list(enumerate(matrices)), "slice long, matrix array<double>")), "slice")
    got = {r.slice: bytes(r.pixels) for r in pixels.warp(rows).collect()}
    assert all(got[k] == (pixels.warped(x[None], m)[0] if m else x).tobytes() for k, (x, m) in enumerate(zip(images, matrices, strict=True)))


def test_augment_works_on_an_image_once(spark):
    """Images pass one step for the warp and the mean, and one for the rest, in as many tasks as there are shuffle partitions."""
    rows = rows_of(spark, [RNG.integers(0, 256, (4, 4)).astype(np.uint8) for _ in range(6)])
    plan = pixels.augment(rows, ["series"], "slice", pixels.Augment(), 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "REPARTITION_BY_NUM" in plan
