"""Hard negatives for each anchor: sorted integer scores of all rows, read between limits that each positive sets.

Every anchor is scored against every row and its scores are sorted whole, by score and id, in runs: rows are dealt into blocks of about BLOCK rows and anchors into strips of
about STRIP, and a task holds one block and one strip. A first pass reads each run's first rows of the anchor's own label; a window over these few merges the runs to the
anchor's positives. A second pass searches each positive's upper limit in every run by bisection, and reads the first rows of other labels from there down to the lower
limit; a window merges them again. What goes from the runs to the windows is `positives`, or `positives` times `negatives`, rows an anchor and block, so neither an anchor's scores nor
the rows of a label meet in one task. The work is anchors times rows by definition; what is shuffled is the rows once a strip and the anchors once a block.

Rows with a null label, a null vector or a null or non-finite component take no part. A row with a null id takes part (last among ties) but is no anchor. Equal ids are
rows of their own. Vectors may differ in length: what one lacks counts as 0. Scores have to stay below 2**56, or an ArithmeticError says so. Anchors without
positives, and positives without a negative between the limits, have no rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

#: Rows of a block and anchors of a strip, on average.
BLOCK, STRIP = 8192, 4096
#: Most partitions that the cells of blocks and strips are dealt to.
PARTITIONS = 20_000
#: Scores that a task sorts at once.
SCORES = 1 << 20
LAST = np.iinfo(np.int64).max


def vectors(rows: DataFrame, key: str, label: Column, vector: str, scale: int, anchors: Column) -> DataFrame:
    """id, label, v (floor of scale times each component), is_anchor of the rows that take part."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    known = rows.where(label.isNotNull() & x.isNotNull() & ~bad)
    return known.select(F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The lists as rows of integers, short ones filled up with zeros."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    counts = np.diff(offsets)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width) < counts[:, None]] = flat
    return out


def _width(table: pa.Table) -> int:
    return pc.max(pc.list_value_length(table.column("v"))).as_py() or 0


class Run:
    """A block's rows in order of id, and the sorted scores of anchors over them."""

    def __init__(self, block: pa.Table, strip: pa.Table):
        width = max(_width(block), _width(strip))
        ids = block.column("id").fill_null(LAST).to_numpy()
        at = np.lexsort((block.column("row").to_numpy(), ids))
        self.null = block.column("id").is_null().to_numpy(zero_copy_only=False)[at]
        self.ids, self.labels, self.rows = ids[at], block.column("label").to_numpy()[at], block.column("row").to_numpy()[at]
        x, a = _matrix(block.column("v"), width)[at], _matrix(strip.column("v"), width)
        most = width * float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(a.astype(np.float64)).max(initial=0))
        if most >= 1 << 56:
            raise ArithmeticError("scores of 2**56 or more")
        kind = np.float64 if most < 1 << 53 else np.int64  # products and sums of doubles are exact below 2**53
        self.x, self.a = x.astype(kind).T, a.astype(kind)

    def scored(self):
        """(anchor's place, rows in order of score and id, their negated scores), one anchor after the other."""
        step = max(1, SCORES // max(len(self.ids), 1))
        for low in range(0, len(self.a), step):
            negated = -(self.a[low : low + step] @ self.x).astype(np.int64)
            order = np.argsort(negated, axis=1, kind="stable")  # rows are in order of id
            for k in range(len(order)):
                yield low + k, order[k], negated[k][order[k]]

    def names(self, at: np.ndarray) -> pa.Array:
        return pa.array(self.ids[at], mask=self.null[at])


def _first_positives(most: int):
    def run(block: pa.Table, strip: pa.Table) -> pa.Table:
        keys, labels = strip.column("row").to_numpy(), strip.column("label").to_numpy()
        found, whose, scores = [], [], []
        if block.num_rows and strip.num_rows:
            r = Run(block, strip)
            for k, order, negated in r.scored():
                at = np.flatnonzero((r.labels[order] == labels[k]) & (r.rows[order] != keys[k]))[:most]
                found.append(order[at])
                scores.append(-negated[at])
                whose.append(np.full(len(at), keys[k]))
            at = np.concatenate(found)
            return pa.table({"anchor": np.concatenate(whose), "id": r.names(at), "score": np.concatenate(scores), "row": r.rows[at]})
        return pa.table({n: pa.array([], pa.int64()) for n in ("anchor", "id", "score", "row")})

    return run


def _between(most: int, low: int, high: int, parts: int):
    def run(block: pa.Table, strip: pa.Table) -> pa.Table:
        keys, labels = strip.column("row").to_numpy(), strip.column("label").to_numpy()
        limits = strip.column("scores").to_pylist()
        found, whose, nth, scores = [], [], [], []
        if block.num_rows and strip.num_rows:
            r = Run(block, strip)
            for k, order, negated in r.scored():
                other = np.flatnonzero(r.labels[order] != labels[k])
                falling = negated[other]
                for n, p in enumerate(limits[k]):
                    begin = int(np.searchsorted(falling, -(high * p // parts)))
                    end = min(begin + most, int(np.searchsorted(falling, low * -p // parts, side="right")))
                    at = other[begin:end]
                    found.append(order[at])
                    scores.append(-negated[at])
                    whose.append(np.full(len(at), keys[k]))
                    nth.append(np.full(len(at), n))
        if not found:
            return pa.table({n: pa.array([], pa.int64()) for n in ("anchor", "nth", "id", "score")})
        at = np.concatenate(found).astype(np.int64)
        return pa.table({"anchor": np.concatenate(whose), "nth": np.concatenate(nth), "id": r.names(at), "score": np.concatenate(scores)})

    return run


def mine_hard_negatives(rows: DataFrame, anchors: Column, key: str = "vec_id", label: Column | None = None, vector: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, parts: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first `positives` rows of the same label, the first
    `negatives` rows of other labels with low * positive_score <= parts * negative_score <= high * positive_score."""
    spark = rows.sparkSession
    with scratch(spark) as keep:
        table = materialize(vectors(rows, key, F.col("label") if label is None else label, vector, scale, anchors).withColumn("row", F.monotonically_increasing_id()), "vectors")
        counts = table.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).first()
        blocks, strips = max(1, math.ceil(counts.n / BLOCK)), max(1, math.ceil(counts.a / STRIP))
        cells = min(2 * blocks * strips, PARTITIONS)
        dealt = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = table.select("id", "label", "v", "row", dealt("row", blocks).alias("block"), all_of(strips).alias("strip")).repartition(cells, "block", "strip").groupBy("block", "strip")
        asked = table.where("is_anchor").select(F.col("id").alias("anchor_id"), "label", "v", "row", dealt("row", strips).alias("strip"))

        def against_blocks(strip: DataFrame):
            fresh = strip.select(*[F.col(c).alias(c) for c in strip.columns])  # other columns than the rows' own, as both come from one table
            return fresh.withColumn("block", all_of(blocks)).repartition(cells, "block", "strip").groupBy("block", "strip")

        own = left.cogroup(against_blocks(asked)).applyInArrow(_first_positives(positives), "anchor bigint, id bigint, score bigint, row bigint")
        first = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        own = own.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives)
        # at most `positives` entries an anchor
        own = materialize(own.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("p")), "positives")
        strip = asked.join(own.select(F.col("anchor").alias("row"), F.col("p.score").alias("scores")), "row")
        found = left.cogroup(against_blocks(strip)).applyInArrow(_between(negatives, low, high, parts), "anchor bigint, nth bigint, id bigint, score bigint")
        first = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
        named = asked.select(F.col("row").alias("anchor"), "anchor_id").join(own, "anchor").select("anchor", "anchor_id", F.posexplode("p").alias("nth", "x"))
        named = named.select("anchor", "anchor_id", F.col("nth").cast("bigint").alias("nth"), F.col("x.id").alias("positive_id"), F.col("x.score").alias("positive_score"))
        out = found.join(named, ["anchor", "nth"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        return keep(materialize(out, "hard-negatives"))
