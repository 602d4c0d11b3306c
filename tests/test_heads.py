from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallow.operators import heads, learn, ranks
from tallow.operators.heads import Shape, Training

SMALL = Shape(2, 3, 4, ("a", "b"), hidden=5, gates=3)


def some(n=6, seed=0):
    rng = np.random.default_rng(seed)
    there = rng.random((n, 2, 3)) > 0.25
    there[0], there[1, 0] = False, False
    w = rng.random((n, 2)) * (rng.random((n, 2)) > 0.3)
    return {"x": rng.normal(size=(n, 2, 3, 4)), "there": there, "series": there.any(2), "planes": rng.integers(0, 4, (n, 2)), "y": np.where(w > 0, rng.integers(0, 2, (n, 2)), np.nan), "w": w}


def test_gradient_is_that_of_finite_differences():
    flat = SMALL.initial(1) + 0.1 * np.random.default_rng(2).normal(size=SMALL.size())
    drop = np.random.default_rng(3).random((6, 5)) * 2
    loss, weight, g = heads.gradient(SMALL, flat, some(), drop)
    assert weight == pytest.approx(some()["w"].sum())
    for k in range(SMALL.size()):
        step = np.zeros_like(flat)
        step[k] = 1e-5
        up, down = (heads.gradient(SMALL, flat + s, some(), drop)[0] for s in (step, -step))
        assert g[k] == pytest.approx((up - down) / 2e-5, abs=2e-5)


def plain_logits(flat, b, k):
    """One study, number by number."""
    p = {n: v.tolist() for n, v in SMALL.unpack(flat).items()}
    dot = lambda u, v: sum(x * y for x, y in zip(u, v, strict=True))

    def pool(rows, keep, name):
        gate = lambda x, n, f: [f(dot(r, x) + c) for r, c in zip(p[f"{name}_{n}"], p[f"{name}_{n}_bias"], strict=True)]
        scores = [dot(p[f"{name}_w"], [t * s for t, s in zip(gate(x, "v", math.tanh), gate(x, "u", lambda z: 1 / (1 + math.exp(-z))), strict=True)]) for x in rows]
        e = [math.exp(s) if ok else 0.0 for s, ok in zip(scores, keep, strict=True)] if any(keep) else [1.0] * len(rows)
        return [sum(a * x[j] for a, x in zip(e, rows, strict=True)) / sum(e) for j in range(len(rows[0]))]

    series = []
    for s in range(2):
        hidden = []
        for x in b["x"][k, s].tolist():
            mean = sum(x) / 4
            root = math.sqrt(sum((v - mean) ** 2 for v in x) / 4 + 1e-5)
            y = [(v - mean) / root * g + c for v, g, c in zip(x, p["norm"], p["norm_bias"], strict=True)]
            z = [dot(r, y) + c for r, c in zip(p["proj"], p["proj_bias"], strict=True)]
            hidden.append([v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
        pooled = pool(hidden, b["there"][k, s].tolist(), "slice")
        series.append([v + e for v, e in zip(pooled, p["plane"][b["planes"][k, s]], strict=True)])
    out = pool(series, b["there"][k].any(1).tolist(), "series")
    return [dot(r, out) + c for r, c in zip(p["head"], p["head_bias"], strict=True)]


def test_forward_is_the_plain_one():
    flat = SMALL.initial(1) + 0.3 * np.random.default_rng(2).normal(size=SMALL.size())
    got = heads.forward(SMALL.unpack(flat), some())[0]
    for k in range(6):
        assert got[k].tolist() == pytest.approx(plain_logits(flat, some(), k), abs=1e-6)


def test_schedule():
    c = Training(epochs=10, batches=10, rate=0.1, warm=0.25)
    rates = [heads.rate_at(k, 100, c)[0] for k in range(100)]
    assert rates[0] == pytest.approx(0.004) and max(rates) == pytest.approx(0.1) and rates.index(max(rates)) == 24 and rates[-1] == pytest.approx(0.1 / 25e4)
    assert all(a < b for a, b in zip(rates[:24], rates[1:25], strict=True)) and all(a > b for a, b in zip(rates[24:-1], rates[25:], strict=True))
    assert heads.rate_at(24, 100, c)[1] == pytest.approx(0.85) and heads.rate_at(0, 1, c)[0] > 0


def table(spark, n=240, dim=8, parts=4):
    """Studies of two series of three slices. Two slices have marks, of equal signs if the label is 1; over all slices they add up to nothing."""
    rng = np.random.default_rng(4)
    vectors, targets = [], []
    for k in range(n):
        y = k % 2
        x = rng.normal(size=(2, 3, dim))
        x[:, :, :2] = 0
        one, other = rng.permutation(6)[:2]
        x.reshape(6, dim)[one, :2] = (3, 3) if y else (3, -3)
        x.reshape(6, dim)[other, :2] = (-3, -3) if y else (-3, 3)
        vectors += [(k, s, t, ["sagittal", "oblique"][s], x[s, t].tolist()) for s in range(2) for t in range(3)]
        targets += [(k, "any", float(y), 1.0), (k, "none", None, 0.0)]
    rows = spark.createDataFrame(vectors, "study long, slot int, slice int, plane string, x array<float>").repartition(parts)
    return rows, spark.createDataFrame(targets, "study long, column string, label double, weight double")


def auc(rows):
    pos, neg = ([p for _, y, p in rows if y == v] for v in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_out_of_fold_beats_the_mean(spark):
    rows, targets = table(spark)
    shape = Shape(2, 3, 8, ("any", "none"), hidden=16, gates=8)
    keys = rows.select("study").distinct()
    folds = ranks.kfold(keys.withColumnRenamed("study", "doc_id"), 2).withColumnRenamed("doc_id", "study")
    items = heads.with_targets(heads.bags(rows, shape), targets, shape).join(folds, "study")
    report: list = []
    c = Training(epochs=30, batches=1, rate=3e-2, noise=0.0, dropout=0.1, slice_dropout=0.0)
    models = heads.train(items, shape, 2, c, report=report)
    assert np.mean(report[-1]) < 0.7 * np.mean(report[0])
    got = heads.predict(items, shape, models, F.col("fold")).where("column = 'any'").collect()
    own = auc([(r.study, r.study % 2, r.p) for r in got])
    mean = rows.groupBy("study").agg(F.array(*[F.avg(F.col("x")[k]) for k in range(8)]).alias("x")).withColumnRenamed("study", "doc_id")
    linear = learn.out_of_fold(mean, targets.withColumnRenamed("study", "doc_id"), folds.withColumnRenamed("study", "doc_id"), ["any"], 2).collect()
    base = auc([(r.doc_id, r.doc_id % 2, r.p) for r in linear])
    assert own > 0.9 and base < 0.7

    # a second stage on a few studies moves the heads only
    gold = items.where("study < 40").withColumn("fold", F.lit(-1))
    tuned = heads.train(gold, shape, 2, Training(epochs=2, batches=1, rate=1e-3), start=models, frozen=("norm", "proj", "slice"))
    moved = {n for n, v in shape.unpack(np.abs(tuned - models).max(0)).items() if v.any()}
    assert moved == {"series_v", "series_v_bias", "series_u", "series_u_bias", "series_w", "plane", "head", "head_bias"}


def test_sums_do_not_depend_on_partitions(spark):
    rows, targets = table(spark, 30)
    shape = Shape(2, 3, 8, ("any",), hidden=6, gates=3)
    items = heads.with_targets(heads.bags(rows, shape), targets, shape).withColumn("fold", (F.col("study") % 3 - 1).cast("int")).withColumn("hash", F.xxhash64("study"))
    models, c = np.stack([shape.initial(k) for k in range(2)]), Training()
    one, many = (heads.summed_gradients(items.repartition(n), shape, models, c, 3) for n in (1, 7))
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(one, many, strict=True))
    assert one[1].tolist() == [20.0, 20.0]
    # and are those of all studies at once, where nothing is drawn
    loss, weight, g = heads.summed_gradients(items, shape, models, c, None)
    held = {r.study: r for r in items.collect()}
    mine = [r for r in held.values() if r.fold != 1]
    there = np.array([r.there for r in mine]).reshape(-1, 2, 3)
    b = {"x": np.stack([np.frombuffer(r.x, np.float32) for r in mine]).reshape(-1, 2, 3, 8).astype(float), "there": there, "series": there.any(2), "planes": np.array([r.planes for r in mine]), "y": np.array([r.y for r in mine]), "w": np.array([r.w for r in mine])}
    want = heads.gradient(shape, models[1], b)
    assert loss[1] == pytest.approx(want[0]) and weight[1] == want[1] and np.allclose(g[1], want[2])


def test_bags(spark, tmp_path):
    shape = Shape(2, 2, 2, ("a",))
    rows = spark.createDataFrame([(1, 0, 0, "axial", [1.0, 2.0]), (1, 1, 1, None, [3.0, 4.0]), (1, 2, 0, "axial", [9.0, 9.0]), (1, 0, 1, "axial", [9.0]), (2, 0, 0, "x", [5.0, 6.0])], "study long, slot int, slice int, plane string, x array<float>")
    got = {r.study: r for r in heads.bags(rows, shape).collect()}
    assert np.frombuffer(got[1].x, np.float32).tolist() == [1, 2, 0, 0, 0, 0, 3, 4] and got[1].there == [True, False, False, True] and got[1].planes == [3, 0]
    assert got[2].there == [True, False, False, False]
    models = np.stack([shape.initial(k) for k in range(2)])
    heads.save_head(spark, shape, models, str(tmp_path / "head"))
    again, back = heads.load_head(spark, str(tmp_path / "head"))
    assert again == shape and (back == models).all()
    p = heads.predict(heads.bags(rows, shape), shape, models).collect()
    assert len(p) == 2 and all(0 < r.p < 1 for r in p)
