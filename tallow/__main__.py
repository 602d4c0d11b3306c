"""python -m tallow <command> --data FOLDER: reports on a collection of CSV splits and scan files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import with_language
from .operators import evaluate, series, votes
from .sources import fixture, scans, tables

KEY = "StudyInstanceUID"


def _reports(split: tables.Split) -> DataFrame:
    if split.reports is None:
        raise SystemExit("this split has no reports")
    return split.reports.withColumnRenamed("report_text", "text")


def _gold(split: tables.Split) -> DataFrame:
    if split.gold is None:
        raise SystemExit("this split has no labels")
    return tables.to_long(split.gold, [c for c in split.gold.columns if c != KEY], KEY).withColumnRenamed("label", "gold")


def _labels(split: tables.Split) -> DataFrame:
    return votes.label_reports(_reports(split), key=KEY)


def _judged(split: tables.Split) -> DataFrame:
    """study, column, label, gold, lang, text: every cell that the collection has a column for."""
    texts = with_language(_reports(split), name="lang")
    return _labels(split).join(_gold(split), [KEY, "column"]).join(texts, KEY)


def label(spark, split, args) -> DataFrame:
    """A label for each study and column, null where the report says nothing."""
    return _labels(split).select(KEY, "column", "label").orderBy(KEY, "column")


def coverage(spark, split, args) -> DataFrame:
    """How many reports each column is labelled in."""
    return evaluate.coverage(_labels(split)).orderBy("column")


def scores(spark, split, args) -> DataFrame:
    """Agreement with the known labels, by column."""
    return evaluate.scores(_judged(split)).orderBy("column")


def languages(spark, split, args) -> DataFrame:
    """Agreement with the known labels, by language."""
    return evaluate.scores_by_language(_judged(split), KEY).orderBy("all_languages", "lang")


def mentions(spark, split, args) -> DataFrame:
    """How far labels could go if every mention were read right."""
    found = votes.mentioned(_reports(split), key=KEY)
    return votes.mention_table(_judged(split).join(found, [KEY, "column"])).orderBy("column")


def triage(spark, split, args) -> DataFrame:
    """Examples of errors of a column, with the sentences that a pattern finds."""
    return votes.error_triage(_judged(split).where(F.col("column") == args.column), args.probe, key=KEY).orderBy("kind", "rank")


def _headers(spark: SparkSession, split: tables.Split, args) -> DataFrame:
    """The first file's header of each series, and how many files it has."""
    root = tables.image_root(spark, args.data, args.split)
    parts = F.split("path", "/")
    files = scans.read_scans(spark, root, "path", "readable", "image_side", "side", "body_part", "position").withColumn("SeriesInstanceUID", F.element_at(parts, -2))
    first = Window.partitionBy("SeriesInstanceUID")
    return files.withColumns({"n": F.count("*").over(first), "k": F.row_number().over(first.orderBy("path"))}).where("k = 1").join(split.series, "SeriesInstanceUID", "left_semi")


def required(spark, split, args) -> DataFrame:
    """Studies of the sample output, those with a series, and those without a row."""
    asked = spark.read.csv(f"{args.data}/sample_submission.csv", header=True)
    return series.required_studies(asked, split.series.withColumn("uid", F.col("SeriesInstanceUID")), KEY)


def sides(spark, split, args) -> DataFrame:
    """How many series have a side that can be told."""
    known = _headers(spark, split, args).select(series.laterality(F.col("image_side"), F.col("side"), F.col("body_part"), F.get("position", F.lit(0))).alias("side"))
    return series.laterality_histogram(known).orderBy("side")


def slices(spark, split, args) -> DataFrame:
    """How many slices series have."""
    return series.slice_count_profile(_headers(spark, split, args).select("n"))


def make(spark, split, args) -> None:
    """Writes a made-up collection of --studies studies."""
    fixture.make_fixture(spark, args.data, args.studies, args.seed)


COMMANDS = {f.__name__: f for f in (label, coverage, scores, languages, mentions, triage, required, sides, slices, make)}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tallow", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        c = commands.add_parser(name, help=f.__doc__)
        c.add_argument("--data", required=True)
        c.add_argument("--split", default="train")
        c.add_argument("--out", help="write CSV to this folder instead of showing the rows")
        if name == "triage":
            c.add_argument("--column", required=True)
            c.add_argument("--probe", required=True)
        if name == "make":
            c.add_argument("--studies", type=int, default=12)
            c.add_argument("--seed", type=int, default=0)
    return out


def run(spark: SparkSession, arguments: list[str] | None = None) -> DataFrame | None:
    """The command's rows, after they were shown or written."""
    args = parser().parse_args(arguments)
    split = None if args.command == "make" else tables.load_split(spark, args.data, args.split)
    rows = COMMANDS[args.command](spark, split, args)
    if rows is not None and args.out:
        tables.write_csv(rows, args.out)
    elif rows is not None:
        rows.show(1000, truncate=False)
    return rows


if __name__ == "__main__":
    run(SparkSession.builder.appName("tallow").getOrCreate())
