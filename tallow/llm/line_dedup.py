"""Line deduplication: which lines of each document stay, as compressed bitmaps.

A line's key is hashed to 128 bits. Occurrences are range-partitioned by hash, document (largest first) and position, and sorted inside the ranges, so a hot key is cut
into several ranges. One streaming pass over each range meets a key's documents one after the other: the first document keeps its lines, those of later ones go as soon as
`documents` of them have been seen. Only the first and the last key of a range can go on elsewhere. For these a range returns the first documents that it saw, and the few lines (of fewer than `documents`
documents) that it can't decide; both are joined afterwards. What goes is collected to a bitmap for each document, and texts are read again only to apply it.

Null texts are empty, which is one empty line. A row with a null doc_id keeps its lines, and they count for nothing. Rows with the same doc_id are one document. A very long text is
handled whole, by one task. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_arrow, map_arrow, materialize, only, scratch

LETTERS, DOCUMENTS = 20, 3
BLANKS = " \t\n\x0b\x0c\r"
ORDER = ["high", "low", "doc_id", "text_hash", "line"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash. The hash tells texts with the same doc_id apart."""
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))


def line_keys(docs: DataFrame, letters: int = LETTERS) -> DataFrame:
    """doc_id, text_hash, lines (of the text), line, high, low of every line whose key has `letters` code points or more."""

    def run(b: pa.RecordBatch) -> dict:
        lists = pc.split_pattern(b.column("text"), "\n")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        keys = pc.ascii_lower(pc.ascii_trim(lists.flatten(), characters=BLANKS))
        at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), letters).to_numpy(zero_copy_only=False))
        coded = keys.take(pa.array(at)).dictionary_encode()
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, as_bytes(coded.dictionary))), dtype=">i8").astype(np.int64).reshape(-1, 2)
        of = np.searchsorted(offsets, at, side="right") - 1
        hashes = digests[coded.indices.to_numpy(zero_copy_only=False)]
        lines = np.diff(offsets)
        take = pa.array(of)
        return {"doc_id": b.column("doc_id").take(take), "text_hash": b.column("text_hash").take(take), "lines": pa.array(lines[of].astype(np.int32)), "line": pa.array((at - offsets[of]).astype(np.int32)), "high": pa.array(hashes[:, 0]), "low": pa.array(hashes[:, 1])}

    return map_arrow(keyed(docs).where("doc_id IS NOT NULL"), run, "doc_id bigint, text_hash bigint, lines int, line int, high bigint, low bigint", "text")


GONE, OPEN, SEEN = 0, 1, 2
MARKS = "kind int, doc_id bigint, text_hash bigint, lines int, line int, high bigint, low bigint"


class Stream:
    """The pass over one sorted range. `out` takes rows that go, rows left open, and the first documents seen of the range's first and last key."""

    def __init__(self, documents: int):
        self.documents, self.key, self.first, self.out = documents, None, True, []

    def batch(self, b: pa.RecordBatch) -> None:
        high, low = b.column("high").to_numpy(), b.column("low").to_numpy()
        begins = np.flatnonzero((high[1:] != high[:-1]) | (low[1:] != low[:-1])) + 1
        begin, last = int(begins[0]) if len(begins) else b.num_rows, int(begins[-1]) if len(begins) else 0
        if self.key is None or (high[0], low[0]) == self.key:  # the range's first key, or the open one goes on
            if self.key is None:
                self._begin(high[0], low[0])
            self._extend(b.slice(0, begin))
        else:
            begin = 0
        if begin < last:
            self._whole(b.slice(begin, last - begin), np.concatenate([[begin], begins[begins > begin]]) - begin)
        if begin < b.num_rows:
            self.close()
            self._begin(high[last], low[last])
            self._extend(b.slice(last))

    def _begin(self, high, low) -> None:
        self.key, self.doc, self.rank, self.seen, self.pending = (high, low), None, -1, [], []

    def _extend(self, b: pa.RecordBatch) -> None:
        """More rows of the open key."""
        doc = b.column("doc_id").to_numpy()
        fresh = np.concatenate([[self.doc is None or doc[0] != self.doc], doc[1:] != doc[:-1]])
        rank = self.rank + np.cumsum(fresh)
        self.seen += doc[fresh & (rank < self.documents)].tolist()
        if self.first:  # an earlier range may hold a larger document
            self._put(OPEN, b.filter(pa.array(rank == 0)))
        self.pending.append(b.filter(pa.array(rank > 0)))
        self.doc, self.rank = doc[-1], int(rank[-1])
        if self.rank + 1 >= self.documents:
            self._flush(GONE)

    def _whole(self, b: pa.RecordBatch, begins: np.ndarray) -> None:
        """Keys that begin and end in this batch; the last one of `begins` is where the open key begins."""
        begins = begins[begins < b.num_rows]
        doc = b.column("doc_id").to_numpy()
        counts = np.diff(np.append(begins, b.num_rows))
        fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
        fresh[begins] = True
        seen = np.cumsum(fresh)
        rank = seen - np.repeat(seen[begins], counts)
        enough = rank[begins + counts - 1] + 1 >= self.documents
        self._put(GONE, b.filter(pa.array((rank > 0) & np.repeat(enough, counts))))

    def close(self, last: bool = False) -> None:
        """The open key ends, or the range does."""
        if self.key is not None and (self.first or last):
            n, nulls = len(self.seen), pa.nulls
            same = lambda v: pa.array([v] * n, pa.int64())
            self._put(SEEN, pa.RecordBatch.from_arrays([pa.array(self.seen, pa.int64()), nulls(n, pa.int64()), nulls(n, pa.int32()), nulls(n, pa.int32()), same(self.key[0]), same(self.key[1])], names=["doc_id", "text_hash", "lines", "line", "high", "low"]))
            self._flush(OPEN)
        self.first = False

    def _flush(self, kind: int) -> None:
        for b in self.pending:
            self._put(kind, b)
        self.pending = []

    def _put(self, kind: int, b: pa.RecordBatch) -> None:
        if b.num_rows:
            self.out.append(pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, kind, np.int32)), *b.columns], names=["kind", *b.schema.names]))

    def drain(self) -> list[pa.RecordBatch]:
        out, self.out = self.out, []
        return out


def repeated_lines(occurrences: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """doc_id, text_hash, lines, line of the lines that go: those of a key that is in `documents` documents or more, but for the largest document's."""

    def run(batches):
        s = Stream(documents)
        for b in batches:
            if b.num_rows:
                s.batch(b)
                yield from s.drain()
        s.close(last=True)
        yield from s.drain()

    columns = ["doc_id", "text_hash", "lines", "line", "high", "low"]
    order = [F.col(c).desc() if c == "doc_id" else F.col(c) for c in ORDER]
    ranges = occurrences.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    marks = materialize(ranges.mapInArrow(run, MARKS), "line-marks")
    # a few documents of two keys a range
    keys = marks.where(F.col("kind") == SEEN).groupBy("high", "low").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("top")).where(F.col("n") >= documents)
    late = marks.where(F.col("kind") == OPEN).join(keys, ["high", "low"]).where("doc_id < top")
    result = ["doc_id", "text_hash", "lines", "line"]
    return marks.where(F.col("kind") == GONE).select(*result).unionByName(late.select(*result))


def keep_bitmaps(docs: DataFrame, letters: int = LETTERS, documents: int = DOCUMENTS) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep: a bit for each line (the first is the highest bit), compressed by zlib. Documents that keep all lines have no row."""
    occurrences = materialize(line_keys(docs, letters), "line-keys")
    gone = repeated_lines(occurrences, documents).distinct()  # rows that repeat whole have the same bitmap
    # a list is bounded by the lines of one text
    lists = gone.groupBy("doc_id", "text_hash").agg(F.first("lines").alias("lines"), F.collect_list("line").alias("gone"))

    def run(batches):
        for b in batches:
            n, dropped = b.column("lines").to_pylist(), b.column("gone")
            keep, counts = [], []
            for k, lines in enumerate(n):
                bits = np.ones(lines, dtype=bool)
                at = dropped[k].values.to_numpy()
                bits[at] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
                counts.append(len(at))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(counts, pa.int64()), pa.array(keep, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])

    return lists.mapInArrow(run, "doc_id bigint, text_hash bigint, n_lines bigint, n_dropped bigint, keep binary")


def kept_text(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """(the text without the lines that go, its lines before, how many go)."""
    if keep is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    kept = [x for x, k in zip(lines, bits.tolist(), strict=True) if k]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, letters: int = LETTERS, documents: int = DOCUMENTS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document. The bitmaps meet the texts, whose digests are all that is returned."""
    spark = docs.sparkSession
    bound_arrow(spark)

    def run(b: pa.RecordBatch) -> dict:
        rows = [kept_text(t, k) for t, k in zip(as_bytes(b.column("text")), b.column("keep").to_pylist(), strict=True)]
        return {"doc_id": b.column("doc_id"), "n_lines": pa.array([r[1] for r in rows], pa.int64()), "n_dropped": pa.array([r[2] for r in rows], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())}

    with scratch(spark) as keep:
        bitmaps = materialize(keep_bitmaps(docs, letters, documents).select("doc_id", "text_hash", "keep"), "keep-bitmaps")
        # texts go to their bitmaps at every size, so that a growing input doesn't change the plan
        joined = keyed(docs).join(bitmaps.hint("merge"), ["doc_id", "text_hash"], "left")
        return keep(materialize(map_arrow(joined, run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string", "text"), "line-dedup"))
