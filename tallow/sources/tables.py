"""Splits of a labelled collection as CSV tables, and the sinks for their results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


@dataclass(frozen=True)
class Split:
    series: DataFrame
    studies: DataFrame
    gold: DataFrame | None
    reports: DataFrame | None


def load_split(spark: SparkSession, folder: str, split: str, key: str = "StudyInstanceUID", text: str = "Report") -> Split:
    """<split>_series.csv (all strings), and <split>.csv if it is there: its text column apart, labels only if columns besides the key remain."""
    series = spark.read.csv(f"{folder}/{split}_series.csv", header=True)
    studies = series.withColumn("_row", F.monotonically_increasing_id()).groupBy(key).agg(F.min("_row").alias("first_row"))
    try:
        table = spark.read.csv(f"{folder}/{split}.csv", header=True, multiLine=True, escape='"')
    except AnalysisException:
        return Split(series, studies, None, None)
    reports = table.select(key, F.col(text).alias("report_text")) if text in table.columns else None
    labels = [c for c in table.columns if c not in (key, text)]
    cell = lambda c: F.nanvl(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(None)).alias(c)
    gold = table.select(key, *[cell(c) for c in labels]) if labels else None
    return Split(series, studies, gold, reports)


def target_columns(spark: SparkSession, path: str, key: str = "StudyInstanceUID", expected: int = 12) -> list[str]:
    """Target names from a sample output's header."""
    names = [c for c in spark.read.csv(path, header=True).columns if c != key]
    if len(names) != expected:
        raise ValueError(f"{path} has {len(names)} targets, not {expected}")
    return names


def with_paths(series: DataFrame, root: str, study: str = "StudyInstanceUID", uid: str = "SeriesInstanceUID") -> DataFrame:
    return series.withColumn("series_dir", F.concat_ws("/", F.lit(root.rstrip("/")), study, uid))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of the files in a folder by path, hidden ones and folders left out (as those that begin with an underscore); none if there is no such folder."""
    try:
        files = spark.read.format("binaryFile").load(folder).select("path", "length")
    except AnalysisException:
        return spark.createDataFrame([], "path string, length bigint")
    own = F.substring_index("path", "/", -1)
    return files.where(~own.startswith(".")).orderBy("path")


def image_root(spark: SparkSession, folder: str, split: str) -> str:
    """<folder>/<split>_series, or <split>_images if only that is there."""
    usual, other = (f"{folder.rstrip('/')}/{split}_{kind}" for kind in ("series", "images"))
    return other if not _exists(spark, usual) and _exists(spark, other) else usual


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return False
    return True


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def to_long(wide: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """key, column, label; a column that isn't there is null, and so is NaN."""
    have = set(wide.columns)
    cells = [F.struct(F.lit(c).alias("column"), (F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) if c in have else F.lit(None).cast("double")).alias("label")) for c in columns]
    return wide.select(key, F.explode(F.array(*cells)).alias("cell")).select(key, "cell.*")
