"""From slices to volumes and training items, and the store's builds."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_pixels import plain_pass

from tallow.operators import items, series
from tallow.sources.store import Store, config_key, config_key_of, extract

RNG = np.random.default_rng(11)


def plain_volume(slices, n, size, plane, side):
    """slices: (number, values or None) of one series."""
    ordered = [v for _, v in sorted(slices)]
    picked = [ordered[int(np.rint(k))] for k in np.linspace(0, len(ordered) - 1, n)] if len(ordered) > 1 else ordered * n
    real = [v for v in picked if v is not None]
    if not real:
        return None
    picked = [np.zeros_like(real[0]) if v is None else v for v in picked]
    flat = np.concatenate([v.ravel() for v in picked])
    lo, hi = np.percentile(flat, 1), np.percentile(flat, 99)
    out = []
    for v in picked:
        b = np.rint((np.clip(v, lo, hi) - lo) / (hi - lo) * 255).astype(int)
        wide = [plain_pass(row, size) for row in b]
        out.append(np.array([plain_pass(c, size) for c in zip(*wide, strict=True)]).T)
    x = np.stack(out)
    if side == "L":
        x = x[::-1] if plane == "sagittal" else x[:, :, ::-1] if plane in ("coronal", "axial") else x
    return x.astype(np.uint8).tobytes()


SERIES = [("s1", "u1", "sagittal", "L", 7), ("s1", "u2", "coronal", "L", 3), ("s1", "u3", "axial", "R", 1), ("s2", "u4", "oblique", "L", 4), ("s3", "u5", "axial", None, 2)]


@pytest.fixture(scope="module")
def made(spark):
    rows, held = [], {}
    for study, uid, plane, side, n in SERIES:
        for k in range(n):
            v = None if uid == "u5" or (uid, k) == ("u1", 2) else RNG.integers(0, 500, (5, 4)).astype(float)
            held.setdefault(uid, []).append((k, v))
            rows.append((study, uid, plane, side, 5, 4, None if v is None else v.ravel().tolist(), n - k))
    slices = spark.createDataFrame(rows, "study string, uid string, plane string, side string, height int, width int, values array<float>, number int").withColumn("number", -F.col("number"))
    info = spark.createDataFrame([(a, b, c, "x") for a, b, c, _, _ in SERIES], "study string, uid string, plane string, contrast string")
    picked = series.select_series(info, ["coronal_any", "sagittal_any"], 2)
    return items.volumes(slices, picked, 5, 3, 2, ["number"]).cache(), held


def test_volumes(made):
    rows, held = made
    got = {(r.study, r.slot): r for r in rows.collect()}
    assert set(got) == {(s, k) for s in ("s1", "s2", "s3") for k in (0, 1)}
    assert [(got["s1", k].uid, got["s1", k].plane) for k in (0, 1)] == [("u2", "coronal"), ("u1", "sagittal")]
    for (study, slot), (uid, plane, side) in {("s1", 0): ("u2", "coronal", "L"), ("s1", 1): ("u1", "sagittal", "L"), ("s2", 0): ("u4", "oblique", "L")}.items():
        assert bytes(got[study, slot].pixels) == plain_volume(held[uid], 5, 3, plane, side) and got[study, slot].mask
    assert got["s2", 0].plane == "unknown"
    for at in (("s2", 1), ("s3", 0), ("s3", 1)):
        assert not got[at].mask and got[at].uid is None and bytes(got[at].pixels) == bytes(45)


def test_volumes_are_stored_once(spark, made, tmp_path):
    rows, _ = made
    whole = rows.groupBy("study").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "study"])).alias("slots"))
    store = Store(spark, f"file://{tmp_path}", {"size": 3, "n": 5}, key="study", right=F.forall("slots", lambda s: F.octet_length(s["pixels"]) == 45))
    studies = rows.select("study").distinct()
    calls = []

    def compute(missing):
        calls.append(missing.count())
        return whole.join(missing, "study", "left_semi")

    first = store.get(studies.where("study < 's3'"), compute)
    again = store.get(studies, compute).select("study", F.explode("slots").alias("s")).select("study", "s.*")
    assert calls == [2, 1] and first.count() == 2
    assert sorted(map(str, again.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_training_items(spark, made, tmp_path):
    rows, _ = made
    targets = spark.createDataFrame([("s1", "a", 1.0, 0.5), ("s1", "b", None, 0.9), ("s2", "a", float("nan"), 1.0), ("s2", "b", 0.0, 1.0), ("s1", "c", 1.0, 1.0)], "study string, column string, label double, weight double")
    wanted = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s9",), ("s1",)], "study string")
    make = lambda epoch, **more: items.training_items(wanted, rows, targets, ["a", "b"], 5, 3, 3, 1, epoch, 4, **more)
    volumes = {(r.study, r.slot): np.frombuffer(r.pixels, np.uint8).reshape(5, 9) for r in rows.collect()}
    got = {r.study: r for r in make(0).collect()}
    assert set(got) == {"s1", "s2", "s3"}
    assert (got["s1"].y, got["s1"].mask, got["s2"].y, got["s2"].mask, got["s3"].mask) == ([1.0, 0.0], [0.5, 0.0], [0.0, 0.0], [0.0, 1.0], [0.0, 0.0])
    assert got["s1"].planes == [2, 1] and got["s2"].series_mask == [True, False]
    for s, r in got.items():
        for k in (0, 1):
            assert bytes(r.pixels[k]) == volumes[s, k][[0, 2, 4]].tobytes()
    shifted = {r.study: r for r in make(0, offset=0.5).collect()}
    assert bytes(shifted["s1"].pixels[1]) == volumes["s1", 1][[1, 3, 4]].tobytes()
    moved = [{r.study: [bytes(p) for p in r.pixels] for r in make(e, jitter=0.9).collect()} for e in (0, 0, 1, 2, 3)]
    assert moved[0] == moved[1] and any(m != moved[0] for m in moved[2:])
    with pytest.raises(ValueError):
        items.training_items(wanted.where("study = 's9'"), rows, targets, ["a"], 5, 3, 3, 1, 0, 4)


def test_epochs_are_orders_of_all_studies(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("study"), F.lit(0).alias("slot"), F.lit(True).alias("mask"), F.lit("axial").alias("plane"), F.unhex(F.lit("0102")).alias("pixels"))
    targets = spark.createDataFrame([(k, "a", 1.0, 1.0) for k in range(200)], "study long, column string, label double, weight double")
    orders = []
    for epoch in (0, 1):
        path = str(tmp_path / f"e{epoch}")
        items.write_epoch(items.training_items(rows, rows, targets, ["a"], 2, 2, 1, 3, epoch, 5), path)
        files = sorted(f for f in os.listdir(path) if f.startswith("part"))
        read = [r for f in files for r in spark.read.parquet(f"{path}/{f}").select("study", "at").collect()]
        assert len(files) == 5 and [r.at for r in read] == sorted(r.at for r in read)
        orders.append([r.study for r in read])
        assert sorted(orders[-1]) == list(range(200))
    assert orders[0] != orders[1]


def test_builds_go_on_after_failures(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", {"v": 1}, key="study")
    rows = spark.createDataFrame([(k, float(v)) for k in range(8) for v in range(3)], "study long, v double")
    bad = tmp_path / "bad"
    bad.write_text("")

    def work(group: pa.Table) -> pa.Table:
        k = group.column("study")[0].as_py()
        if k % 3 == 0 and os.path.exists(bad):
            raise ValueError(f"no study {k}")
        return pa.table({"study": [k], "total": [sum(group.column("v").to_pylist()) + k]})

    assert store.build(rows, work, "study long, total double") == (5, 3)
    assert {(r.study, r.error) for r in store.failures().collect()} == {(k, f"ValueError: no study {k}") for k in (0, 3, 6)}
    assert store.build(rows, work, "study long, total double") == (0, 3)  # only what failed
    assert store.build(rows, work, "study long, total double", attempts=2) == (0, 0)
    bad.unlink()
    assert store.build(rows, work, "study long, total double") == (3, 0)
    assert {r.study: r.total for r in store.read().collect()} == {k: 3.0 + k for k in range(8)}


def test_builds_survive_a_lost_worker(spark, tmp_path):
    """A task that dies fails its job, and leaves nothing behind that counts as done."""
    store, killer = Store(spark, f"file://{tmp_path}/store", {"v": 1}, key="study"), tmp_path / "kill"
    killer.write_text("")
    rows = spark.range(6).select(F.col("id").alias("study"))

    def work(group: pa.Table) -> pa.Table:
        if os.path.exists(killer) and group.column("study")[0].as_py() == 4:
            os._exit(1)
        return group

    with pytest.raises(Exception):
        store.build(rows, work, "study long")
    assert store.read() is None and store.failures() is None
    killer.unlink()
    assert store.build(rows, work, "study long") == (6, 0) and store.read().count() == 6


def test_features_are_extracted_once(spark, tmp_path):
    loads = tmp_path / "loads"

    def load():
        with open(loads, "a") as f:
            f.write("x")
        weights = np.arange(6).reshape(3, 2)
        return lambda x: (x @ weights).astype(np.float32)

    store = Store(spark, f"file://{tmp_path}/features", {"encoder": "stub"}, key="id", right=F.col("features").isNull() | (F.size("features") == 2))
    rows = spark.range(40).select("id", F.when(F.col("id") != 7, F.array(*[(F.col("id") * k).cast("float") for k in (1, 2, 3)])).alias("x")).repartition(4)
    got = {r.id: r.features for r in extract(store, rows.where("id < 25"), "x", load, batch=4, shape=[3]).collect()}
    assert got[7] is None and got[3] == [3 * (0 + 4 + 12), 3 * (1 + 6 + 15)]
    before = loads.read_text()
    assert 0 < len(before) <= 8  # not once a batch
    assert extract(store, rows.where("id < 25"), "x", load, shape=[3]).count() == 25 and loads.read_text() == before
    assert extract(store, rows, "x", load, shape=[3]).count() == 40


def test_keys_of_configurations(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n long, s string")
    got = [r.k for r in rows.orderBy("n").select(config_key_of(z=F.col("n"), a=F.col("s")).alias("k")).collect()]
    assert got == [config_key({"z": 1, "a": "a"}), config_key({"z": 2, "a": None})]
