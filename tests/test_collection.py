"""From a made-up collection on disk to trained heads, and the commands."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallow import __main__ as cli
from tallow.operators import heads, items, labels, ranks, series
from tallow.sources import fixture, scans, tables
from tallow.sources.store import Store, extract

N = 60


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('collection')}"
    fixture.make_fixture(spark, path, N, seed=2)
    return path


def test_same_seed_same_collection(spark, folder, tmp_path):
    fixture.make_fixture(spark, f"file://{tmp_path}", N, seed=2)
    files = [{(r.path.rsplit("train_series/", 1)[1], tuple(r.pixels or ())) for r in scans.read_scans(spark, f"{f}/train_series", "path", "pixels").collect()} for f in (folder, f"file://{tmp_path}")]
    assert files[0] == files[1] and any(not p for _, p in files[0]) and any(p for _, p in files[0])


def test_commands(spark, folder, tmp_path, capsys):
    run = lambda *a: [r.asDict() for r in cli.run(spark, [a[0], "--data", folder, *a[1:]]).collect()]
    truth = {r.StudyInstanceUID: r for r in fixture.studies(spark, N, 2).collect()}
    got = {r["StudyInstanceUID"]: r["label"] for r in run("label") if r["column"] == "Effusion"}
    assert got == {s: float(r.truth) if r.told else None for s, r in truth.items()}
    cover = {r["column"]: r for r in run("coverage")}
    assert cover["Effusion"]["labelled"] == sum(r.told for r in truth.values())
    score = {r["column"]: r for r in run("scores")}["Effusion"]
    assert score["agreement"] == 1.0 and score["n_gold"] == sum(r.gold for r in truth.values())
    assert {r["lang"] for r in run("languages") if r["all_languages"] == 0} and {r["column"] for r in run("mentions")} == {"Effusion", "Fracture"}
    assert all(r["kind"] == "MISSED" for r in run("triage", "--column", "Effusion", "--probe", "effusion|knee"))
    assert run("required") == [{"required": N, "resolved": N, "missing": 0}]
    assert {r["side"] for r in run("sides")} == {"L", "R"} and run("slices")[0]["p5"] >= 3
    cli.run(spark, ["coverage", "--data", folder, "--out", str(tmp_path / "csv")])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 12
    with pytest.raises(SystemExit):
        cli.run(spark, ["nothing"])


def test_from_files_to_heads(spark, folder, tmp_path):
    split = tables.load_split(spark, folder, "train")
    files = scans.read_scans(spark, tables.image_root(spark, folder, "train"))
    parts = F.split("path", "/")
    side = series.laterality(F.col("image_side"), F.col("side"), F.col("body_part"), F.get("position", F.lit(0)))
    slices = files.select(F.element_at(parts, -3).alias("study"), F.element_at(parts, -2).alias("uid"), side.alias("side"), F.col("rows").alias("height"), F.col("columns").alias("width"), F.col("pixels").alias("values"), "position", "instance", "orientation", "path")
    about = slices.groupBy("uid").agg(F.min_by("orientation", "path").alias("iop"))
    plane, contrast = series.series_kind(F.col("Anatomical_Plane"), F.col("Fluid_Sensitive"), F.lit(None), F.col("iop"))
    info = split.series.withColumnRenamed("SeriesInstanceUID", "uid").join(about, "uid").select(F.col("StudyInstanceUID").alias("study"), "uid", plane.alias("plane"), contrast.alias("contrast"))
    assert info.where("plane = 'unknown'").count() == 0  # the cosines tell what the table doesn't
    order = series.slice_order(F.col("position"), series_normal(F.col("orientation")), F.col("instance"), F.lit(0))
    slices = slices.join(info.select("uid", "plane"), "uid").withColumn("order", order)
    picked = series.select_series(info, ["sagittal_any", "coronal_any", "axial_any"], 2)
    made = items.volumes(slices, picked, 4, 6, 2, ["order"])
    store = Store(spark, f"file://{tmp_path}/volumes", {"n": 4}, key="study")
    whole = made.groupBy("study").agg(F.collect_list(F.struct("slot", "uid", "mask", "plane", "side", "pixels")).alias("slots"))
    back = store.get(info.select("study").distinct(), lambda todo: whole.join(todo, "study", "left_semi")).select("study", F.explode("slots").alias("s")).select("study", "s.*")
    assert back.count() == 2 * N

    # an encoder of samples of one slice, and a head on what it gives
    pieces = back.where("mask").select("study", "slot", "plane", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slice"), "pixels")
    x = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda k: F.conv(F.substring(F.hex("pixels"), (F.col("slice") * 36 + k) * 2 + 1, F.lit(2)), 16, 10).cast("float"))
    pieces = pieces.select("study", "slot", "slice", "plane", F.concat_ws("/", "study", "slot", "slice").alias("id"), x.alias("x"))

    def load():
        middle, rim = [14, 15, 20, 21], [0, 5, 30, 35]
        return lambda v: np.stack([v.mean(1), v.std(1), v[:, middle].mean(1), v[:, rim].mean(1), *np.percentile(v, [10, 50, 90], axis=1), np.full(len(v), 128.0)], axis=1).astype(np.float32) / 255

    features = extract(Store(spark, f"file://{tmp_path}/features", {"e": 1}, key="id"), pieces, "x", load, shape=[36])
    vectors = pieces.drop("x").join(features.withColumnRenamed("features", "x"), "id")
    shape = heads.Shape(2, 4, 8, ("Effusion",), hidden=16, gates=8)
    gold = tables.to_long(split.gold, ["Effusion"], "StudyInstanceUID").withColumnRenamed("StudyInstanceUID", "study")
    from tallow.operators.votes import label_reports

    pseudo = label_reports(split.reports.withColumnRenamed("report_text", "text"), key="StudyInstanceUID", columns=["Effusion"]).withColumnRenamed("StudyInstanceUID", "study")
    targets = labels.build_targets(pseudo.select("study", "column"), pseudo, gold, key="study")
    folds = ranks.kfold(info.select(F.col("study").alias("doc_id")).distinct(), 2).withColumnRenamed("doc_id", "study")
    bags = heads.with_targets(heads.bags(vectors, shape), targets, shape).join(folds, "study")
    got = heads.out_of_fold(bags, shape, 2, heads.Training(epochs=45, batches=1, rate=3e-2, noise=0.0, dropout=0.0)).collect()
    truth = {r.StudyInstanceUID: r.truth for r in fixture.studies(spark, N, 2).collect()}
    pos, neg = ([r.p for r in got if truth[r.study] == v] for v in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) > 0.8


def series_normal(iop):
    a = [F.get(iop, F.lit(k)) for k in range(6)]
    return F.array(a[1] * a[5] - a[2] * a[4], a[2] * a[3] - a[0] * a[5], a[0] * a[4] - a[1] * a[3])
