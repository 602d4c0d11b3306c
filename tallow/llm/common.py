"""What the operators share: table readers, shared folders, Arrow batches of bounded size, words."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step inside a task handles at once; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20
#: Rows of one Arrow batch from the JVM, so that a batch of long texts stays small.
ARROW_ROWS = 512

M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_arrow(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in a local session without one, a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: The tables that materialize has written inside the innermost `scratch` of this thread.
_written = threading.local()


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts the lineage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if (tables := getattr(_written, "tables", None)) is not None:
        tables.append((path, out))
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes what materialize writes inside, at its end, but for the tables that the function it gives was called on; those belong to the scratch around it."""
    outer, mine, kept = getattr(_written, "tables", None), [], []
    _written.tables = mine

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _written.tables = outer
        for path, table in mine:
            if not any(table is k for k in kept):
                remove_path(spark, path)
            elif outer is not None:
                outer.append((path, table))


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def batches_of(batches: Iterator[pa.RecordBatch], column: str, target: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts and joins Arrow batches so that each has about `target` bytes in `column`, one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        lens = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lens)
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            n = int(np.searchsorted(ends, base + max(target - size, 1), side="left")) + 1 - at
            n = min(max(n, 1), b.num_rows - at)
            held.append(b.slice(at, n))
            size += int(ends[at + n - 1] - base)
            at += n
            if size >= target:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, by: str, target: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow over batches with about `target` bytes of column `by`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, by, target):
            out = f(b)
            if isinstance(out, dict):
                out = pa.RecordBatch.from_pydict(out)
            if out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 of a string column without nulls; slices of one buffer, much faster than to_pylist()."""
    _, offsets, data = column.buffers()
    if data is None:
        return [b""] * len(column)
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    low = int(at[0])
    whole = data[low : int(at[-1])].to_pybytes()
    ends = (at - low).tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch of texts: codes into `vocab`, and where each text's words begin."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        full = pc.greater(pc.binary_length(flat), 0)
        n_full = pc.sum(full).as_py() or 0
        if n_full < len(flat):
            mask = full.to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(mask)])[offsets]
            flat = flat.filter(full)
        coded = flat.dictionary_encode()
        self.offsets = offsets
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocab: list[bytes] = as_bytes(coded.dictionary)
        self.counts = np.diff(offsets)

    def mapped(self, f: Callable[[bytes], int], dtype=np.uint64) -> np.ndarray:
        """f of each word in text order; f runs once for each distinct word."""
        return np.fromiter(map(f, self.vocab), dtype=dtype, count=len(self.vocab))[self.codes]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+counts[i]-1, one range after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    at, step = 1, np.uint64(base & M64)
    while at < n:
        take = min(at, n - at)
        out[at : at + take] = out[:take] * step
        at += take
        step = np.uint64(int(step) * int(step) & M64)
    return out


class Rolling:
    """Polynomial hashes of any spans of a sequence of 64-bit word hashes, by prefix sums mod 2**64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, hashes: np.ndarray, base: int = BASE):
        n = len(hashes)
        self.up = powers(base, n + 1)
        self.down = powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * self.up[:n], out=self.sums[1:])

    def spans(self, starts: np.ndarray, length) -> np.ndarray:
        return mix64((self.sums[starts + length] - self.sums[starts]) * self.down[starts])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by exact name, so that other columns with clashing names don't matter."""
    return df.select(*[F.col(f"`{n}`") for n in names])
