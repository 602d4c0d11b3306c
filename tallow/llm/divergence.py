"""How far the sources of a language differ in their words: sums of absolute differences of smoothed term shares, without a row for terms that two sources both lack.

Terms kept (in at least `documents` documents of their language) form postings: a row for each language, source and term that occurs. The sum for two sources s and t over all kept terms is
put together from

- one-sided terms: the sum of |p_s - z_t| over all terms of s, z_t being the share of a term that t lacks. It needs only the histogram of s's counts: running sums over its
  values, in order, are read at z_t, so a histogram is sorted once for all other sources;
- overlaps: where both have the term, |p_s - p_t| takes the place of both one-sided values. These corrections come from a join of postings on the term, summed before the
  shuffle. Sources are dealt into cells of about CELL, and a term's postings meet in pairs of cells, so that no task holds all pairs of a term that every source uses;
- terms that both lack: a constant times their number.

Shares are integers, computed by long division in steps that don't leave 64 bits (below 9e15 occurrences in a language). Shuffled are counts by language, source and term, which tasks add up
first; a hot source is no hot key, as its terms are keys of their own. The rows of the result, all other sources of each source, are as many as asked for.

A null text, lang or source is ''. Every language and source that occurs has rows for all other sources of the language, without terms too (then a term's share is the
smoothing alone; with no kept terms all sums are 0). Very long texts are read whole, ties are ordered by the item's UTF-8. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, bound_arrow, map_arrow, materialize, only, scratch

DOCUMENTS, SMOOTHING, TERMS = 30, 5, 50
#: Sources of a cell, on average.
CELL = 256
#: Letters, lower-case; other ASCII signs part terms.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def _letters_only(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case and blanks for ASCII signs that are no letters; other bytes stay, so they stay UTF-8."""
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    own = LETTERS[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]  # of these texts alone, as batches are slices
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(own))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents with the term."""

    def run(b: pa.RecordBatch) -> dict:
        words = Words(_letters_only(b.column("text")))
        size = max(len(words.vocab), 1)
        at, n = np.unique(np.repeat(np.arange(b.num_rows), words.counts) * size + words.codes, return_counts=True)
        pairs = pa.StructArray.from_arrays([b.column("lang"), b.column("source")], names=["lang", "source"]).to_pylist()
        number: dict[tuple, int] = {}
        group = np.array([number.setdefault((p["lang"], p["source"]), len(number)) for p in pairs], dtype=np.int64)
        keys, back = np.unique(group[at // size] * size + at % size, return_inverse=True)
        groups, terms = pa.array(keys // size), pa.array(words.vocab, pa.binary()).cast(pa.string()).take(pa.array(keys % size))
        names = list(number)
        take = lambda k: pa.array([x[k] for x in names], pa.string()).take(groups)
        return {"lang": take(0), "source": take(1), "term": terms, "n": pa.array(np.bincount(back, n, len(keys)).astype(np.int64)), "docs": pa.array(np.bincount(back, minlength=len(keys)).astype(np.int64))}

    rows = map_arrow(docs, run, "lang string, source string, term string, n bigint, docs bigint", "text")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * (count + SMOOTHING) / total), by long division three digits at a time."""
    part = lambda rest: (F.call_function("div", rest * 1000, total), rest * 1000 % total)
    a, rest = part(count + SMOOTHING)
    b, rest = part(rest)
    c, _ = part(rest)
    return a * 1_000_000 + b * 1000 + c + 1


def _unordered(rows: DataFrame, s: str, t: str) -> DataFrame:
    return rows.withColumn("a", F.least(s, t)).withColumn("b", F.greatest(s, t))


def audit_tables(docs: DataFrame, documents: int) -> tuple[DataFrame, DataFrame]:
    """(groups: lang, source, total, z, terms, v, lang_total; postings: lang, source, term, n, p, z, q). total is N + SMOOTHING * V, null without kept terms."""
    counted = materialize(term_counts(docs), "term-counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= documents).drop("docs")
    postings = materialize(counted.drop("docs").join(kept, ["lang", "term"]), "kept-terms")
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    langs = postings.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_distinct("term").alias("v"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("n", F.lit(0)) + SMOOTHING * F.col("v")).alias("total"), (F.col("n_lang") + SMOOTHING * F.col("v")).alias("lang_total"))
    groups = materialize(groups.withColumn("z", share(F.lit(0), F.col("total"))), "groups")
    priced = postings.join(groups.select("lang", "source", "total", "lang_total", "z"), ["lang", "source"])
    priced = priced.select("lang", "source", "term", "n", share(F.col("n"), F.col("total")).alias("p"), "z", share(F.col("n_lang"), F.col("lang_total")).alias("q"))
    return groups, materialize(priced, "postings")


def one_sided(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, other, value: the sum of |p - z of the other| over the source's terms; a row for each other source of the language."""
    histogram = postings.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count("*").alias("k"))
    points = histogram.select("lang", "source", "at", "k", F.lit(None).cast("string").alias("other"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("at"))
    asked = groups.select("lang", "source").join(others, "lang").where("source <> other").select("lang", "source", "at", F.lit(0).cast("bigint").alias("k"), "other")
    below = Window.partitionBy("lang", "source").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("lang", "source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mass = F.col("k") * F.coalesce("at", F.lit(0))
    sums = points.unionByName(asked).select("lang", "source", "other", "at", F.sum("k").over(below).alias("k"), F.sum(mass).over(below).alias("m"), F.sum("k").over(whole).alias("all_k"), F.sum(mass).over(whole).alias("all_m"))
    value = F.col("all_m") - F.col("at") * F.col("all_k") + 2 * (F.col("at") * F.col("k") - F.col("m"))
    return sums.where("other IS NOT NULL").select("lang", "source", "other", F.coalesce(value, F.lit(0)).alias("value"))


def overlaps(postings: DataFrame, cells: int) -> DataFrame:
    """lang, a, b, value, both: for sources a < b, what their common terms add to the one-sided sums, and how many there are."""
    own = F.pmod(F.xxhash64("source"), F.lit(cells)).cast("int")
    rows = postings.select("lang", "term", "source", "p", "z", own.alias("cell")).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    rows = rows.select("lang", "term", "source", "p", "z", "cell", F.least("cell", "with").alias("i"), F.greatest("cell", "with").alias("j"))
    here = F.least("x.cell", "y.cell").eqNullSafe(F.col("x.i")) & F.greatest("x.cell", "y.cell").eqNullSafe(F.col("x.j"))
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("lang", "term", "i", "j")]
    met = rows.alias("x").join(rows.alias("y"), [*on, F.col("x.source") < F.col("y.source"), here])
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    value = gap("x.p", "y.p") - gap("x.p", "y.z") - gap("x.z", "y.p")
    return met.groupBy(F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(value).alias("value"), F.count("*").alias("both"))


def pair_sums(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language, in both orders."""
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    sides = _unordered(one_sided(groups, postings), "source", "other").groupBy("lang", "a", "b").agg(F.sum("value").alias("sides"))
    common = overlaps(postings, max(1, math.ceil(most / CELL)))
    side = lambda n: groups.select("lang", F.col("source").alias(n), F.col("terms").alias(f"terms_{n}"), F.col("z").alias(f"z_{n}"), *(["v"] if n == "a" else []))
    rows = sides.join(common, ["lang", "a", "b"], "left").join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    neither = F.col("v") - F.col("terms_a") - F.col("terms_b") + F.coalesce("both", F.lit(0))
    value = F.col("sides") + F.coalesce("value", F.lit(0)) + F.coalesce(neither * F.abs(F.col("z_a") - F.col("z_b")), F.lit(0))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return rows.select("lang", both.alias("x"), value.alias("value")).select("lang", "x.source", "x.item", "value")


def source_divergence(docs: DataFrame, documents: int = DOCUMENTS, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: 'pair' rows for all other sources of the language, and 'term' rows for the first `terms` terms that a source uses more than
    its language does."""
    spark = docs.sparkSession
    bound_arrow(spark)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    with scratch(spark) as keep:
        groups, postings = audit_tables(only(docs, "lang", "source", "text").select(*map(text, ("lang", "source", "text"))), documents)
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = pair_sums(groups, postings).withColumn("rank", F.row_number().over(order))
        more = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        more = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms)
        parts = [rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, rows in (("pair", pairs), ("term", more))]
        return keep(materialize(parts[0].unionByName(parts[1]), "divergence"))
