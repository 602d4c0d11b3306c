"""Substring dedup over a log-structured index of window fingerprints.

A window is `window` consecutive words of one document. Its anchor is the smallest hash among its runs of ANCHOR words, which
depends on the window's words alone, so equal windows have equal anchors. Neighbouring windows with one anchor form a stretch, hashed
whole: about one row for each dozen windows. The index maps (anchor, stretch) to the smallest document that holds it, and to the place
there. It is a folder of immutable runs, sorted by ranges of (anchor, stretch), with a manifest, so that a later call can open it. Each batch of documents, in
order of doc_id, is merge-joined with the runs and decided by them: a stretch that a smaller document of a run or of the batch holds is removed
whole. An anchor whose stretches differ from one document to another is verified window by window, on the texts, with two independent 64-bit
hashes of all the window's words. Then the batch's new stretches become a run, and runs are compacted into one once they are many.
The whole table is such a list of batches, whose texts are verified together; dedup_batch takes one batch against an index of earlier ones.
A document whose word sequence repeats a smaller document's is settled before, without windows.

Hot passages: stretches and windows are added up before shuffles, and a join's one-row-a-key side is written first, so that both sides are plain shuffles, which
adaptive execution splits where a key is hot.

Nulls: a null text has no words. Rows with a null doc_id are kept whole and never match. Rows of one doc_id never remove
words from each other, whether their texts are the same or not; each row gets a result. Texts of fewer words than a window stay whole. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import Rolling, Words, bound_arrow, map_arrow, materialize, new_path, only, ragged, remove_path, scratch, signed

WINDOW = 50
#: Words of an anchor. Half a window: about one anchor in a dozen words.
ANCHOR = 25
BATCHES = 3
#: Runs that the index may have; more are merged into one.
FAN_IN = 2
SECOND_BASE = 0xC2B2AE3D27D4EB4F
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _hashes(words: Words) -> np.ndarray:
    return words.mapped(xxhash.xxh3_64_intdigest)


def _windows(words: Words, window: int, anchor: int):
    """Rolling hashes, and first word, document and anchor of every window of the batch."""
    roll = Rolling(_hashes(words))
    n_win = np.maximum(words.counts - window + 1, 0)
    doc = np.repeat(np.arange(len(n_win)), n_win)
    first = ragged(words.offsets[:-1], n_win)
    n = len(words.codes)
    if not len(first):
        return roll, first, doc, np.zeros(0, np.uint64)
    grams = roll.spans(np.arange(n - anchor + 1), anchor)
    width = window - anchor + 1
    low, w = grams, 1
    while 2 * w <= width:  # minimum over the next 2w grams
        low = np.minimum(low[: len(low) - w], low[w:])
        w *= 2
    rest = width - w
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return roll, first, doc, low[first]


#: A document row: rows of one doc_id with different texts stay apart.
KEY = ["doc_id", "tk"]


def _keyed(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tk"))


def profile(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document: n_words, sha256 of its words joined by one space, and its stretches (anchor, stretch, first window, windows)."""
    bound_arrow(docs.sparkSession)

    def run(b: pa.RecordBatch) -> dict:
        words = Words(b.column("text"))
        roll, first, doc, low = _windows(words, window, anchor)
        shas, vocab = [], words.vocab
        for a, e in itertools.pairwise(words.offsets.tolist()):
            shas.append(hashlib.sha256(b" ".join([vocab[c] for c in words.codes[a:e].tolist()])).hexdigest())
        if len(first):
            cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (low[1:] != low[:-1])]))
            n = np.diff(np.append(cut, len(first)))
            h, d, at = low[cut], doc[cut], first[cut]
            r = roll.spans(at, n + window - 1)
            start = at - words.offsets[d]
        else:
            h = r = np.zeros(0, np.uint64)
            d = start = n = np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=b.num_rows))]).astype(np.int32)
        lists = pa.StructArray.from_arrays([pa.array(signed(h)), pa.array(signed(r)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "r", "start", "n"])
        return {"doc_id": b.column("doc_id"), "tk": b.column("tk"), "n_words": pa.array(words.counts.astype(np.int64)), "sha": pa.array(shas), "stretches": pa.ListArray.from_arrays(pa.array(offsets), lists)}

    return map_arrow(_keyed(docs), run, "doc_id bigint, tk bigint, n_words bigint, sha string, stretches array<struct<h: bigint, r: bigint, start: int, n: int>>", "text")


#: A row of the index: the smallest document that holds the stretch, and where.
ENTRY = "h bigint, r bigint, doc_id bigint, tk bigint, start int, n int"


class FingerprintIndex:
    """Sorted, immutable runs of ENTRY below a folder, no (h, r) in two of them. The newest manifest there says which runs are the index's."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.folder = folder or new_path(spark, "fingerprint-index")
        self.runs: list[str] = []
        self.version, self.made = 0, 0
        if folder and (saved := self._manifest()):
            self.version, self.made, self.runs = saved

    def _manifest(self) -> tuple[int, int, list[str]] | None:
        try:
            row = self.spark.read.schema("version bigint, made bigint, runs array<string>").json(f"{self.folder}/manifest-*").orderBy(F.desc("version")).first()
        except AnalysisException:
            return None
        return (row.version, row.made, list(row.runs)) if row else None

    def add(self, new: DataFrame) -> None:
        """new: ENTRY rows whose (h, r) no run has."""
        self._write(new)
        if len(self.runs) > self.fan_in:
            self.compact()
        else:
            self._save()

    def compact(self) -> None:
        """Merges the runs into one; the old files stay until the manifest that doesn't name them is written."""
        old, merged = self.runs, self.table()
        self.runs = []
        self._write(merged)
        self._save()
        for run in old:
            remove_path(self.spark, f"{self.folder}/{run}")

    def table(self) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(*[f"{self.folder}/{r}" for r in self.runs])

    def drop(self) -> None:
        remove_path(self.spark, self.folder)
        self.runs = []

    def _write(self, df: DataFrame) -> None:
        name, self.made = f"run-{self.made:06d}", self.made + 1
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartitionByRange(parts, "h", "r").sortWithinPartitions("h", "r").write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        self.runs.append(name)

    def _save(self) -> None:
        self.version += 1
        rows = self.spark.createDataFrame([(self.version, self.made, self.runs)], "version bigint, made bigint, runs array<string>")
        rows.coalesce(1).write.json(f"{self.folder}/manifest-{self.version:06d}")


def batch_bounds(profiles: DataFrame, batches: int) -> list[int]:
    """doc_ids that split the documents into batches of about one size."""
    if batches < 2:
        return []
    found = profiles.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0]
    return sorted(set(found or []))


def match_batch(index: FingerprintIndex, stretches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Joins a batch (KEY, h, r, start, n; no smaller doc_id than earlier batches) with the index, then adds it. Returns KEY, start, n of the stretches that a
    smaller document holds, and KEY, start, n, own of those to be verified: first ones under an anchor with several, of the batch (own) and of the runs."""
    firsts = materialize(stretches.groupBy("h", "r").agg(F.min(F.struct("doc_id", "tk", "start", "n")).alias("f")).select("h", "r", "f.*"), "stretches-first")
    old = materialize(index.table().join(materialize(firsts.select("h").distinct(), "anchors"), "h", "left_semi"), "stretches-known")
    least = old.select("h", "r", "doc_id").unionByName(firsts.select("h", "r", "doc_id")).groupBy("h", "r").agg(F.min("doc_id").alias("first_doc"))
    mixed = materialize(old.select("h", "r").unionByName(firsts.select("h", "r")).distinct().groupBy("h").count().where("count > 1").select("h"), "anchors-mixed")
    flagged = materialize(least.join(mixed.withColumn("mixed", F.lit(True)), "h", "left").select("h", "r", "first_doc", F.coalesce("mixed", F.lit(False)).alias("mixed")), "stretches-least")
    marked = materialize(stretches.join(flagged, ["h", "r"]).where("mixed OR doc_id > first_doc").select(*KEY, "start", "n", (F.col("doc_id") > F.col("first_doc")).alias("again")), "stretches-marked")
    index.add(firsts.join(old.select("h", "r"), ["h", "r"], "left_anti"))
    unsure = marked.where("NOT again").select(*KEY, "start", "n", F.lit(True).alias("own"))
    unsure = unsure.unionByName(old.join(mixed, "h", "left_semi").select(*KEY, "start", "n", F.lit(False).alias("own")))
    return marked.where("again").select(*KEY, "start", "n"), unsure


def verify(docs: DataFrame, unsure: DataFrame, window: int = WINDOW) -> DataFrame:
    """KEY, start, n of the windows of `own` stretches that start in a smaller document of those given; docs holds all their texts."""
    at = F.collect_list(F.struct("start", "n", "own"))
    lists = unsure.groupBy(*KEY, "start", "n").agg(F.max("own").alias("own")).groupBy(*KEY).agg(at.alias("at"))
    windows = materialize(map_arrow(_keyed(docs).join(lists, KEY), lambda b: _window_hashes(b, window), "doc_id bigint, tk bigint, start int, own boolean, w1 bigint, w2 bigint", "text"), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    first = materialize(first, "windows-first")
    return windows.where("own").join(first, ["w1", "w2"]).where("doc_id > lo").select(*KEY, "start", F.lit(1).alias("n"))


def stretches_of(profiles: DataFrame) -> DataFrame:
    return profiles.where("doc_id IS NOT NULL").select(*KEY, F.explode("stretches").alias("s")).select(*KEY, "s.*")


def _spans(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def removed_spans(docs: DataFrame, profiles: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """KEY and spans: arrays of (start, n) of the windows to be removed, for documents with any. profiles must be a written table."""
    stretches = stretches_of(profiles)
    index = FingerprintIndex(docs.sparkSession)
    found = []
    for low, high in itertools.pairwise([None, *batch_bounds(profiles, batches), None]):
        part = stretches
        if low is not None:
            part = part.where(F.col("doc_id") >= low)
        if high is not None:
            part = part.where(F.col("doc_id") < high)
        found.append(match_batch(index, part))
    whole, unsure = (functools.reduce(DataFrame.unionByName, x) for x in zip(*found, strict=True))
    spans = materialize(_spans(whole.unionByName(verify(docs, unsure, window))), "spans")
    index.drop()
    return spans


def dedup_batch(index: FingerprintIndex, batch: DataFrame, history: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of a batch of new documents, whose doc_ids are beyond those of `history`, the documents that the index
    was made of. Afterwards the index knows the batch too."""
    with scratch(batch.sparkSession) as keep:
        profiles = keep(materialize(profile(batch, window, anchor), "profiles"))
        whole, unsure = match_batch(index, stretches_of(profiles))
        known = only(history, "doc_id", "text").unionByName(only(batch, "doc_id", "text"))
        spans = keep(materialize(_spans(whole.unionByName(verify(known, unsure, window))), "spans"))
    return _cut(batch, profiles.select(*KEY, "n_words", "sha"), None, spans, window)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """offsets, start and n of a column of arrays of (start, n); null is empty."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.flatten()
    return offsets - offsets[0], flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)


def _window_hashes(b: pa.RecordBatch, window: int) -> dict:
    words = Words(b.column("text"))
    hashes = _hashes(words)
    one, two = Rolling(hashes), Rolling(hashes ^ (hashes >> np.uint64(29)), SECOND_BASE)
    offsets, start, n = _lists(b.column("at"))
    doc = np.repeat(np.repeat(np.arange(b.num_rows), np.diff(offsets)), n)
    first = ragged(start, n)
    at = first + words.offsets[doc]
    own = np.repeat(b.column("at").flatten().field("own").to_numpy(zero_copy_only=False), n)
    return {"doc_id": b.column("doc_id").take(pa.array(doc)), "tk": b.column("tk").take(pa.array(doc)), "start": pa.array(first.astype(np.int32)), "own": pa.array(own, pa.bool_()), "w1": pa.array(signed(one.spans(at, window))), "w2": pa.array(signed(two.spans(at, window)))}


def _kept(b: pa.RecordBatch, window: int) -> tuple[Words, np.ndarray]:
    """The batch's words, and which of them no removed window covers."""
    words = Words(b.column("text"))
    offsets, start, n = _lists(b.column("spans"))
    begin = start + np.repeat(words.offsets[:-1], np.diff(offsets))
    edge = np.zeros(len(words.codes) + 1, dtype=np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + n + window - 1, -1)
    return words, np.cumsum(edge[:-1]) == 0


def decide(docs: DataFrame, window: int, anchor: int, batches: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: a row per document (KEY, n_words, sha); KEY of those whose whole word sequence a smaller document has; and KEY with removed spans."""
    with scratch(docs.sparkSession) as keep:
        profiles = keep(materialize(profile(docs, window, anchor), "profiles"))
        heads = profiles.select(*KEY, "n_words", "sha")
        sized = heads.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
        firsts = sized.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
        copies = keep(materialize(sized.select(*KEY, "sha").join(firsts, ["doc_id", "sha"], "left_anti").select(*KEY).distinct(), "copies"))
        own = profiles.join(firsts, ["doc_id", "sha"], "left_semi")
        return heads, copies, keep(removed_spans(docs, own, window, batches))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space)."""
    return _cut(docs, *decide(docs, window, anchor, batches), window)


def _cut(docs: DataFrame, heads: DataFrame, copies: DataFrame | None, spans: DataFrame, window: int) -> DataFrame:
    """The result rows: documents with spans are read again, the others' hashes are known."""

    def cut(b: pa.RecordBatch) -> dict:
        words, keep = _kept(b, window)
        shas, removed = [], []
        for joined, n in _joined(words, keep):
            shas.append(hashlib.sha256(joined).hexdigest())
            removed.append(n)
        return {"doc_id": b.column("doc_id"), "n_words": pa.array(words.counts.astype(np.int64)), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}

    changed = map_arrow(_keyed(docs).join(spans, KEY), cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", "text")
    rest = heads.join(spans.select(*KEY), KEY, "left_anti")
    rest = rest.withColumn("copy", F.lit(None).cast("boolean")) if copies is None else rest.join(copies.withColumn("copy", F.lit(True)), KEY, "left")
    copy = F.col("copy").isNotNull()
    rest = rest.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.col("sha")).alias("kept_sha256"))
    return changed.unionByName(rest)


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """The rows of docs, of doc_id, text and any other columns, without repeated passages. Rows that lose none keep their text as it is; the others' words are joined by
    one space, and n_chars, if there is one, counts them anew. Rows of which nothing is left go."""
    _, copies, spans = decide(docs, window, anchor, batches)
    names = docs.columns
    keyed = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "tk": F.xxhash64("text")})
    rest = keyed.join(copies.unionByName(spans.select(*KEY)), KEY, "left_anti").select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)

    def cut(b: pa.RecordBatch) -> dict:
        words, keep = _kept(b, window)
        texts = pa.array([joined for joined, _ in _joined(words, keep)], pa.binary()).cast(pa.string())
        return {n: texts if n == "text" else b.column(n) for n in names}

    changed = map_arrow(keyed.join(spans, KEY), cut, schema, "text").where("text <> ''")
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.length("text").cast(rest.schema["n_chars"].dataType))
    return rest.unionByName(changed)


def _joined(words: Words, keep: np.ndarray):
    """Each text's kept words, one space apart, and how many it lost."""
    vocab = words.vocab
    for a, e in itertools.pairwise(words.offsets.tolist()):
        k = keep[a:e]
        yield b" ".join([vocab[c] for c in words.codes[a:e][k].tolist()]), e - a - int(k.sum())
