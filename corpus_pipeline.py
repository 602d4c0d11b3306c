"""From raw documents to packed sequences, in stages that are each written as Parquet and read again.

Each stage decides on all that its predecessor kept. Nulls: a null text is empty; rows with a null doc_id pass the filters, except that the
near-duplicate stage can keep only one row of a group. Empty tables give empty results. Other columns than those of documents are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.llm import decontamination, packing, simhash, substring_dedup, toxicity
from tallow.llm.common import materialize, only, scratch, table
from tallow.llm.queries import fold

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The near-duplicate stage's shingles, and the Jaccard similarity of their sets.
SHINGLE = 5
SIMILARITY = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine doesn't reject."""
    docs = only(docs, *COLUMNS)
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), fold(4) != 2, columns=COLUMNS)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, of a similarity of SIMILARITY or more on SHINGLE words: its smallest doc_id, the smallest text if that repeats."""
    docs = only(docs, *COLUMNS)
    return simhash.first_of_each_group(docs, shingle=SHINGLE, similarity=SIMILARITY)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller doc_id holds; documents of which nothing is left go, empty ones stay."""
    return substring_dedup.without_repeats(only(docs, *COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.without_benchmark(only(docs, *COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(only(docs, *COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Tokenizer, string kernel and fingerprints are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:  # a stage's own tables go once its result is written
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
    return docs
