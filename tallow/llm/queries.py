"""One query for each operator, over its whole table: the operator's own output, reduced to the columns of its result."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, hard_negatives, language_model, line_dedup, media, packing, quality, simhash, substring_dedup, token_counts, toxicity, warc
from .common import materialize, scratch, table


def fold(parts: int, key: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo parts."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts))


def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its result written, so that the tables on the way to it can go."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark) as keep:
            return keep(materialize(query(spark, sf_dir), query.__name__))

    return run


@tidy
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


@tidy
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


@tidy
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@tidy
def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_column(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type")


@tidy
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), fold(5) == 1)


@tidy
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


@tidy
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the fold 2 of 4 are held out."""
    out = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(4) != 2)
    return out.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@tidy
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@tidy
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@tidy
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(4) != 2)
    return out.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, label = F.col("vec_id"), F.col("label").cast("bigint")
    moved = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings"), key % 100 == 0, label=moved)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_substring_dedup, op3_warc, op4_media, op5_lm_score, op6_simhash, op7_quality, op8_decontamination, op9_token_counts, op10_toxicity, op11_hard_negatives, op12_line_dedup, op13_divergence)}
