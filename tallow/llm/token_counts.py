"""Exact token counts from a histogram of encoded lengths.

Documents are encoded once and counted by length; Spark adds the counts up before its shuffle, so a hot length costs a row
a task. Suffix sums over the histogram answer, for each context limit: how many documents are longer, how many tokens
stay if documents are cut there, and the quantiles. The sums run in two levels, inside blocks of lengths and over the blocks,
so no task holds the whole histogram.

Nulls: a null text is empty, length 0. Empty tables give an empty histogram. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_arrow, map_arrow, materialize, only
from .tokens import default_vocabulary, encoder

#: Lengths in one block of the suffix sums.
BLOCK = 4096


def encoded_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and n_tokens of each document."""
    vocabulary = vocabulary or default_vocabulary()
    bound_arrow(docs.sparkSession)

    def count(b: pa.RecordBatch) -> dict:
        _, lens = encoder(vocabulary).batch(b.column("text"))
        return {"doc_id": b.column("doc_id"), "n_tokens": pa.array(lens.astype(np.int64))}

    return map_arrow(only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), count, "doc_id bigint, n_tokens bigint", "text")


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    return lengths.groupBy(F.col(column).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length: n_docs, and over all lengths at least that long docs_ge and tokens_ge; from them kept_tokens, the tokens that remain if
    documents are cut to this length, and quantile, the share of documents that are no longer."""
    block = F.floor(F.col("n_tokens") / BLOCK)
    h = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", block)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # one row a block of 4096 lengths: the longest text bounds them
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    blocks = blocks.select("block", over("d", above).alias("d_above"), over("t", above).alias("t_above"), F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (F.sum("n_docs").over(inside) + F.col("d_above")).alias("docs_ge"),
        (F.sum("tokens").over(inside) + F.col("t_above")).alias("tokens_ge"),
    )
    return out.select(
        "n_tokens", "n_docs", "docs_ge", "tokens_ge",
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("kept_tokens"),
        ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def kept_at(sums: DataFrame, limit: int | Column) -> DataFrame:
    """Totals for any context limit: the row of the shortest length that is no shorter, carried down to the limit."""
    longer = sums.where(F.col("n_tokens") >= limit).agg(F.min_by(F.struct("n_tokens", "docs_ge", "kept_tokens"), "n_tokens").alias("s"))
    everything = sums.agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("all_tokens"))
    cut = F.col("s.kept_tokens") - (F.col("s.n_tokens") - F.lit(limit)) * F.col("s.docs_ge")
    return longer.join(everything).select(F.lit(limit).cast("long").alias("context_limit"), F.coalesce(F.col("s.docs_ge"), F.lit(0)).alias("docs_ge"), F.coalesce(cut, "all_tokens").alias("kept_tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents doesn't exceed."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The histogram is written once, as both levels of sums read it and the texts should be encoded only once."""
    return suffix_sums(materialize(length_histogram(encoded_lengths(docs, vocabulary)), "length-histogram"))
