"""Best-fit packing of tokenized documents into sequences of a fixed length, in bulk-synchronous rounds.

Documents become pieces of at most `seq_len` ids. Spark range-sorts the pieces by (length, doc_id, piece) and ranks them
inside their length without a group a length: each sorted partition numbers its rows, and the partitions' counts, added
up, shift them. Pieces of one length are interchangeable, and so are open sequences with one gap, so the rounds work on
runs of equals, (length, ranks) and (gap, sequences): some thousand rows whatever the corpus holds.

A round is one Spark job. Runs of pieces and of gaps meet in ranges of size, a task each. A task sweeps its range from long to short: every piece seeks its
successor, the smallest gap that holds it; if more pieces want a gap than there are sequences with it, the lower ranks get it and the others go on
to the next gap. Gaps shrink, and go to the range of what is left of them. Pieces that find no gap in their range seek in the next one. Pieces of which fewer fit
a sequence seek before others (one, two, three, more). Once none seeks any more, those left start over if any piece was placed since they started, and otherwise as
many sequences are opened as their ids fill.
In the end each piece is joined with the run of its length and rank.

Nulls: a null text is an empty one (its separator id alone). A null doc_id is an id like any other. Empty tables give no rows.
Ties: equal lengths rank by doc_id and piece. Repeated rows are packed as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_arrow, map_arrow, materialize, only, scratch
from .tokens import default_vocabulary, encoder

SEQ_LEN = 2048
#: The id that ends a document.
SEPARATOR = 0

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(docs: DataFrame, seq_len: int = SEQ_LEN, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, input_ids."""
    vocabulary = vocabulary or default_vocabulary()
    bound_arrow(docs.sparkSession)

    def cut(b: pa.RecordBatch) -> dict:
        ids, lens = encoder(vocabulary).batch(b.column("text"))
        ends = np.cumsum(lens)
        ids = np.insert(ids, ends, SEPARATOR).astype("<u4")
        lens = lens + 1
        begins = np.cumsum(lens) - lens
        n = -(-lens // seq_len)
        doc = np.repeat(np.arange(len(lens)), n)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * seq_len
        length = np.minimum(seq_len, lens[doc] - start)
        data = memoryview(ids.tobytes())
        at = (begins[doc] + start) * 4
        crc = [zlib.crc32(data[a : a + k]) for a, k in zip(at.tolist(), (length * 4).tolist(), strict=True)]
        out = {"doc_id": b.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            out["input_ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
        return out

    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_arrow(docs, cut, PIECES + ", input_ids array<int>" * with_ids, "text")


#: A run of n equals. Gaps: size, first sequence. Pieces: size, first rank, and the range they seek in. Placed pieces: both, and the offset.
RUN = "kind int, level int, size bigint, rank bigint, sequence bigint, n bigint, offset bigint"
GAP, PIECE, PLACED = 0, 1, 2


def ranges_of(seq_len: int) -> list[int]:
    """Where ranges of sizes begin."""
    return sorted({1, max(1, seq_len // 4)})


def bands_of(seq_len: int) -> list[int]:
    """The smallest sizes of which one, two or three fit a sequence, and 1."""
    return sorted({max(1, seq_len // (k + 1) + 1) for k in (1, 2, 3)} | {1}, reverse=True)


def sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], seq_len: int):
    """Runs (length, first rank, n) of pieces into runs (gap, first sequence, n), longest first, each into the smallest gap that holds it. Returns placed runs
    (length, first rank, first sequence, n, offset), and what is left of the pieces and of the gaps."""
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []  # in order
    placed, left = [], []

    def put(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if not open_[gap]:
                bisect.insort(sizes, gap)
            open_[gap].append((sequence, n))

    for run in gaps:
        put(*run)
    for length, rank, n in sorted(pieces, key=lambda r: (-r[0], r[1])):
        while n and (at := bisect.bisect_left(sizes, length)) < len(sizes):
            gap = sizes[at]
            sequence, bins = open_[gap].pop()
            if not open_[gap]:
                sizes.pop(at)
            deep = gap // length
            # whole columns of `deep` pieces a sequence, then one sequence with fewer
            for width, each in ((min(bins, n // deep), deep), (1, n % deep if n // deep < bins else 0)):
                if width and each:
                    placed += [(length, rank + k * width, sequence, width, seq_len - gap + k * length) for k in range(each)]
                    put(gap - each * length, sequence, width)
                    rank, n, sequence, bins = rank + each * width, n - each * width, sequence + width, bins - width
            put(gap, sequence, bins)
        if n:
            left.append((length, rank, n))
    return placed, left, [(gap, sequence, n) for gap in sizes for sequence, n in open_[gap]]


def best_fit_runs(counts: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """length, rank, n, sequence, offset: where runs of ranks of each length go; counts holds length and n."""
    spark = counts.sparkSession
    ranges, bands = ranges_of(seq_len), bands_of(seq_len)
    waiting, unreleased = len(ranges), len(ranges) + 1

    def level(size: int) -> int:
        return bisect.bisect_right(ranges, size) - 1

    def meet(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        here = rows[0]["level"]
        runs = {kind: [(r["size"], r["sequence" if kind == GAP else "rank"], r["n"]) for r in rows if r["kind"] == kind] for kind in (GAP, PIECE)}
        placed, left, gaps = sweep(runs[PIECE], runs[GAP], seq_len)
        out = [(PLACED, -1, size, rank, sequence, n, offset) for size, rank, sequence, n, offset in placed]
        out += [(PIECE, here if here >= waiting else here + 1, size, rank, None, n, None) for size, rank, n in left]
        out += [(GAP, level(size), size, None, sequence, n, None) for size, sequence, n in gaps]
        return pa.table({f.name: pa.array([r[k] for r in out], f.type) for k, f in enumerate(t.schema)})

    own = sum((F.col("size") >= edge).cast("int") for edge in ranges[1:]) + F.lit(0)  # the range of a size
    null = F.lit(None).cast("long")
    columns = {"kind": F.lit(PIECE), "level": F.lit(unreleased), "size": F.col("length"), "rank": F.lit(0).cast("long"), "sequence": null, "n": F.col("n"), "offset": null}
    state = materialize(counts.select(*[c.alias(n) for n, c in columns.items()]), "packing-runs")
    held = [F.count_if((F.col("size") >= low) & (F.col("size") < high)) for low, high in zip(bands, [seq_len + 1, *bands], strict=False)]
    *held, made = state.agg(*held, F.coalesce(F.sum(F.when(F.col("size") > seq_len // 2, F.col("n"))), F.lit(0))).first()  # no two of the last share a sequence
    bands = [low for low, n in zip(bands, held, strict=True) if n]
    opened, moved, seeking, ids, plans = made, False, 0, len(bands), []
    piece = F.col("kind") == PIECE
    while ids:
        if not seeking:
            if bands:
                ready, at = (F.col("level") == unreleased) & (F.col("size") >= bands.pop(0)), own
            else:
                ready, at = F.col("level") == waiting, own if moved else F.lit(level(seq_len))  # new sequences are tried first
                opened = 0 if moved else -(-ids // seq_len)
                made, moved = made + opened, False
            state = state.withColumn("level", F.when(piece & ready, at).otherwise(F.col("level")).cast("int"))
        if opened:
            state = state.unionByName(spark.createDataFrame([(GAP, level(seq_len), seq_len, None, made - opened, opened, None)], RUN))
            opened = 0
        out = materialize(state.groupBy("level").applyInArrow(meet, RUN), "packing-round")
        plans.append(out.where(F.col("kind") == PLACED))
        state = out.where(F.col("kind") != PLACED)
        left = F.coalesce(F.sum(F.when(piece, F.col("size") * F.col("n"))), F.lit(0))
        placed, seeking, ids = out.agg(F.count_if(F.col("kind") == PLACED), F.count_if(piece & (F.col("level") < waiting)), left).first()
        moved = moved or placed > 0
    plan = functools.reduce(DataFrame.unionByName, plans) if plans else state.limit(0)
    return plan.select(F.col("size").alias("length"), "rank", "n", "sequence", "offset")


def pack(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Adds sequence_id and offset to a table with `length`, `doc_id` and `piece`; other columns stay."""
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = pieces.columns
    with scratch(spark) as keep:
        held = materialize(pieces, "pieces")
        sorted_ = held.repartitionByRange(parts, "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
        ranked = keep(materialize(sorted_.withColumn("_at", F.monotonically_increasing_id()), "pieces-ranked")).withColumn("_part", F.shiftright("_at", 33))
        # A sorted partition holds a range of lengths, so there are at most seq_len + partitions groups.
        groups = ranked.groupBy("length", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        groups = keep(materialize(groups.withColumn("_before", before), "pieces-groups"))
        plan = keep(materialize(best_fit_runs(groups.groupBy("length").agg(F.sum("_n").alias("n")), seq_len), "packing-plan"))
    # both sides that are broadcast have some thousand rows
    place = F.broadcast(plan.select("length", F.col("rank").alias("_from"), F.col("n").alias("_many"), "sequence", "offset"))
    out = ranked.join(F.broadcast(groups.drop("_n")), ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_at") - F.col("_first"))
    out = out.join(place, "length").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_many")))
    return out.select(*[F.col(f"`{n}`") for n in names], (F.col("sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def best_fit_packing(docs: DataFrame, seq_len: int = SEQ_LEN, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    return pack(pieces_of(docs, seq_len, vocabulary, with_ids), seq_len)
