"""A small made-up collection in the layout that `load_split` and `read_scans` read: reports, labels, series and scan files, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import uniform
from .scans import write_scans
from .tables import write_csv

#: What a report says of its first column, by the truth, in five languages; others say nothing of it.
SENTENCES = {
    1: ["A large effusion distends the joint.", "Hay un derrame abundante.", "Eklemde yaygin efuzyon vardir.", "Massiver Erguss im Recessus.", "Ruime hydrops."],
    0: ["The knee is without effusion.", "Ausencia de derrame.", "Efuzyon yok.", "Ohne Erguss.", "Zonder hydrops."],
}
SILENT = "The knee was imaged in three planes."
PLANES = ["Sagittal", "Coronal", "Axial"]
COSINES = [[0.0, 1.0, 0.0, 0.0, 0.0, -1.0], [1.0, 0.0, 0.0, 0.0, 0.0, -1.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]]
COLUMNS = ["Effusion", "Fracture"]


def _pick(values: list, key) -> F.Column:
    return F.element_at(F.array(*[F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def studies(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """number, StudyInstanceUID, truth (of the first column), told (whether the report says it), gold (whether the label is known), side."""
    k, draw = F.col("number"), lambda name: uniform(F.lit(seed), F.col("number"), F.lit(name))
    rows = spark.range(n).withColumnRenamed("id", "number")
    return rows.select("number", F.concat(F.lit("study-"), F.lpad(k.cast("string"), 8, "0")).alias("StudyInstanceUID"), (draw("truth") < 0.5).cast("int").alias("truth"), (draw("told") < 0.8).alias("told"), (draw("gold") < 0.3).alias("gold"), F.when(draw("side") < 0.5, "L").otherwise("R").alias("side"))


def make_fixture(spark: SparkSession, folder: str, n: int = 12, seed: int = 0, side: int = 8) -> None:
    """Writes train.csv, train_series.csv, sample_submission.csv and train_series/<study>/<series>/<number>.scan below a folder. Each study has one to three series of three to six slices; where
    the first label is 1, one slice of each series is bright in the middle. One file in twenty is cut."""
    rows = studies(spark, n, seed)
    said = F.when(~F.col("told"), SILENT).when(F.col("truth") == 1, _pick(SENTENCES[1], F.col("number"))).otherwise(_pick(SENTENCES[0], F.col("number")))
    known = lambda y: F.when(F.col("gold"), y)
    write_csv(rows.select("StudyInstanceUID", said.alias("Report"), known(F.col("truth")).alias(COLUMNS[0]), known(F.lit(0)).alias(COLUMNS[1])), f"{folder}/train.csv")
    write_csv(rows.select("StudyInstanceUID", *[F.lit(0.5).alias(c) for c in COLUMNS]), f"{folder}/sample_submission.csv")
    many = (F.floor(uniform(F.lit(seed), F.col("number"), F.lit("series")) * 3) + 1).cast("int")
    series = rows.select("*", F.explode(F.sequence(F.lit(0), many - 1)).alias("k")).withColumn("SeriesInstanceUID", F.concat("StudyInstanceUID", F.lit("."), "k"))
    write_csv(series.select("StudyInstanceUID", "SeriesInstanceUID", F.when(F.col("number") % 4 > 0, _pick(PLANES, F.col("k"))).alias("Anatomical_Plane"), F.when(F.col("number") % 5 > 0, (F.col("k") % 2).cast("string")).alias("Fluid_Sensitive")), f"{folder}/train_series.csv")
    length = (F.floor(uniform(F.lit(seed), F.col("SeriesInstanceUID")) * 4) + 3).cast("int")
    slices = series.withColumn("n", length).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    y, x = (F.floor(F.col("_j") / side), F.col("_j") % side)
    middle = (F.abs(y - side / 2) < side / 4) & (F.abs(x - side / 2) < side / 4)
    bright = (F.col("truth") == 1) & (F.col("at") == F.floor(F.col("n") / 2)) & middle
    samples = slices.select("*", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("_j"))
    value = (F.when(bright, 3000).otherwise(400) + F.floor(uniform(F.lit(seed), F.col("SeriesInstanceUID"), F.col("at"), F.col("_j")) * 200)).cast("int")
    keys = ["StudyInstanceUID", "SeriesInstanceUID", "k", "at", "number", "side"]
    images = samples.withColumn("v", value).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_j", "v"))).alias("s"))  # one small image
    cut = uniform(F.lit(seed), F.col("SeriesInstanceUID"), F.col("at"), F.lit("cut")) < 0.05
    pixels = F.transform("s", lambda e: e["v"])
    spot = F.when(F.col("side") == "L", 40.0).otherwise(-40.0)
    files = images.select(
        F.concat_ws("/", "StudyInstanceUID", "SeriesInstanceUID", F.concat(F.lpad(((F.col("at") * 7) % 10).cast("string"), 2, "0"), F.lit(".scan"))).alias("path"),
        F.lit(side).alias("rows"), F.lit(side).alias("columns"), F.lit(1).alias("frames"), F.when(cut, F.slice(pixels, 1, 3)).otherwise(pixels).alias("values"), F.col("at").cast("double").alias("instance"),
        _pick(COSINES, F.col("k")).alias("orientation"), F.array(F.when(F.col("k") == 0, spot + F.col("at")).otherwise(spot), F.when(F.col("k") == 1, F.col("at").cast("double")).otherwise(0.0), F.when(F.col("k") == 2, F.col("at").cast("double")).otherwise(0.0)).alias("position"),
        F.when(F.col("number") % 2 == 0, F.col("side")).alias("side"),
    )
    write_scans(files, f"{folder}/train_series")
