"""Benchmark decontamination: an exact, prefix-filtered join of item windows with document words.

A window is `window` consecutive item words (an item with fewer words is one window). Words are ordered by rarity: a first pass over
all documents counts how often each benchmark word occurs. A document that holds a window holds each of its words, so
its rarest word is a sufficient prefix for an exact containment. The second pass looks up only these words: at each
occurrence the window would have to begin at the word's position less its place in the window (positional bound) and end inside the document (length
bound); what remains is verified word by word. The benchmark is the query set: it goes to the tasks in blocks of at most BLOCK_WINDOWS
windows, so what a task holds is bounded however large the benchmark is, and each block passes over all documents.

Nulls: a null text has no words; such items never occur. Item and document ids may be null or repeat: a repeated item is listed once by its id.
Empty tables: no items give no hits, no documents no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batches_of, bound_arrow, materialize, only, ragged

WINDOW = 10
#: Windows of the benchmark that a task holds at once, with some 100 bytes each.
BLOCK_WINDOWS = 200_000
#: Candidate windows that a task verifies at once.
CANDIDATES = 1_000_000

#: A-Z to lower case; the other ASCII signs but digits and letters part words.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case."""
    return text.translate(CLEAN).split() if text else []


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (string), words of each distinct window of each item."""

    def run(batches):
        for b in batches:
            ids, out = [], []
            texts = b.column("text").fill_null("")
            for i, t in zip(b.column("item_id").to_pylist(), as_bytes(texts), strict=True):
                w = words_of(t)
                found = {b" ".join(w[k : k + window]) for k in range(max(1, len(w) - window + 1))} if w else set()
                ids += [i] * len(found)
                out += sorted(found)
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.string()), "words": pa.array(out, pa.binary()).cast(pa.string())})

    return only(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item_id string, words string").distinct()


def word_counts(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """How often each of these words occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(vocabulary)})

    def run(batches):
        index = shared.value
        total = np.zeros(len(index) + 1, dtype=np.int64)
        get = index.get
        for b in batches_of(batches, "text"):
            words = _flat(b)[0]
            total += np.bincount(np.array([get(w, -1) for w in words], dtype=np.int64) + 1, minlength=len(total))
        at = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_pydict({"k": pa.array(at, pa.int64()), "n": pa.array(total[at + 1], pa.int64())})

    found = only(docs, "text").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    out = dict.fromkeys(vocabulary, 0)
    out.update({vocabulary[r.k]: r.n for r in found.collect()})  # at most the block's words
    return out


def _flat(b: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """All words of the batch, and where each document's begin."""
    texts = as_bytes(b.column("text").fill_null(""))
    lists = [words_of(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]).astype(np.int64)
    return list(itertools.chain.from_iterable(lists)), offsets


class Matcher:
    """The windows of a block, each under its rarest word."""

    def __init__(self, windows: list[tuple[bytes, ...]], items: list[list[str]], counts: dict[bytes, int]):
        self.items = items
        vocabulary = sorted({w for ws in windows for w in ws})
        self.code = {w: k for k, w in enumerate(vocabulary)}  # a word's number is the same in windows and documents
        n = len(windows)
        self.length = np.array([len(w) for w in windows], dtype=np.int64)
        self.words = np.full((n, max(self.length.max(), 1)), -1, dtype=np.int32)
        place = np.zeros(n, dtype=np.int64)
        rare = np.zeros(n, dtype=np.int64)
        for k, ws in enumerate(windows):
            self.words[k, : len(ws)] = [self.code[w] for w in ws]
            place[k] = min(range(len(ws)), key=lambda j: (counts.get(ws[j], 0), ws[j]))
            rare[k] = self.code[ws[place[k]]]
        order = np.argsort(rare, kind="stable")
        self.of, self.place = order, place
        self.begin = np.searchsorted(rare[order], np.arange(len(vocabulary) + 1))

    def batch(self, words: list[bytes], offsets: np.ndarray):
        """Occurrences: (document, first word in the batch, window)."""
        get = self.code.get
        codes = np.array([get(w, -1) for w in words], dtype=np.int32)
        prefix = np.diff(self.begin)
        at = np.flatnonzero(codes >= 0)
        at = at[prefix[codes[at]] > 0]
        # occurrences times the windows under their word, in parts of about CANDIDATES
        cuts = np.searchsorted(np.cumsum(prefix[codes[at]]), np.arange(0, int(prefix[codes[at]].sum()), CANDIDATES), side="left") if len(at) else [0]
        parts = [self._verified(at[a:e], codes, offsets, prefix) for a, e in itertools.pairwise([*dict.fromkeys([0, *[int(c) for c in cuts], len(at)])])]
        return tuple(np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]) for k in range(3))

    def _verified(self, at: np.ndarray, codes: np.ndarray, offsets: np.ndarray, prefix: np.ndarray):
        n = prefix[codes[at]]
        window = self.of[ragged(self.begin[:-1][codes[at]], n)]
        at = np.repeat(at, n)
        doc = np.searchsorted(offsets, at, side="right") - 1
        start = at - self.place[window]
        ok = (start >= offsets[doc]) & (start + self.length[window] <= offsets[doc + 1])
        doc, start, window = doc[ok], start[ok], window[ok]
        for k in range(self.words.shape[1]):  # verify word by word
            if not len(start):
                break
            inside = k < self.length[window]
            ok = ~inside | (codes[np.minimum(start + k, len(codes) - 1)] == self.words[window, k])
            doc, start, window = doc[ok], start[ok], window[ok]
        return doc, start, window


HITS = "doc_id bigint, n_words bigint, spans array<struct<start: int, n: int>>, items array<string>"


def matchers(docs: DataFrame, benchmark: DataFrame, window: int, block_windows: int) -> list:
    """A broadcast matcher for each block of the benchmark (one that holds None for an empty benchmark)."""
    spark = docs.sparkSession
    bound_arrow(spark)
    windows = materialize(item_windows(benchmark, window).groupBy("words").agg(F.collect_set("item_id").alias("items")), "item-windows")
    blocks = max(1, -(-windows.count() // block_windows))
    out = []
    for k in range(blocks):
        rows = (windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k)).collect()
        split = [tuple(r.words.encode().split(b" ")) for r in rows]
        matcher = None
        if rows:
            vocabulary = sorted({w for ws in split for w in ws})
            matcher = Matcher(split, [sorted(x for x in r["items"] if x is not None) for r in rows], word_counts(docs, vocabulary))
        out.append(spark.sparkContext.broadcast(matcher))
    return out


def _hits(shared, batches):
    matcher = shared.value
    for b in batches_of(batches, "text"):
        words, offsets = _flat(b)
        n = b.num_rows
        doc, start, window = matcher.batch(words, offsets) if matcher else (np.zeros(0, np.int64),) * 3
        length = matcher.length[window] if matcher else start
        order = np.argsort(doc, kind="stable")
        doc, start, length, window = doc[order], start[order], length[order], window[order]
        cuts = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
        items = [sorted({i for w in set(window[a:e].tolist()) for i in matcher.items[w]}) if e > a else [] for a, e in itertools.pairwise(cuts.tolist())]
        spans = pa.StructArray.from_arrays([pa.array((start - offsets[doc]).astype(np.int32)), pa.array(length.astype(np.int32))], ["start", "n"])
        out = {"doc_id": b.column("doc_id"), "n_words": pa.array(np.diff(offsets)), "spans": pa.ListArray.from_arrays(pa.array(cuts), spans), "items": pa.array(items, pa.list_(pa.string()))}
        yield pa.RecordBatch.from_pydict(out)


def _digest(batches):
    """n_hit and the items' digest from spans and items."""
    for b in batches:
        spans, items = b.column("spans"), b.column("items")
        offsets = spans.offsets.to_numpy().astype(np.int64)
        flat = spans.flatten()
        start, n = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
        offsets -= offsets[0]
        hit, shas, many = [], [], []
        for k, found in enumerate(items.to_pylist()):
            s, e = start[offsets[k] : offsets[k + 1]], n[offsets[k] : offsets[k + 1]]
            hit.append(len(np.unique(ragged(s, e))) if len(s) else 0)
            found = sorted(set(found))
            many.append(len(found))
            shas.append(hashlib.sha256(",".join(found).encode()).hexdigest())
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_words": b.column("n_words"), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array(many, pa.int64()), "items_sha256": pa.array(shas), "contaminated": pa.array([h > 0 for h in hit], pa.bool_())})


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    blocks = matchers(docs, benchmark, window, block_windows)
    if len(blocks) == 1:
        return docs.mapInArrow(functools.partial(_hits, blocks[0]), HITS).mapInArrow(_digest, schema)
    # a row's hits from all blocks meet again under its number
    numbered = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    keyed = numbered.select(F.col("row").alias("doc_id"), "text")
    parts = functools.reduce(DataFrame.unionByName, [keyed.mapInArrow(functools.partial(_hits, m), HITS) for m in blocks])
    both = parts.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    found = both.withColumnRenamed("doc_id", "row").join(numbered.select("row", "doc_id"), "row").select("doc_id", "n_words", "spans", "items")
    return found.mapInArrow(_digest, schema)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs; block after block, without a shuffle."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for m in matchers(docs, benchmark, window, block_windows):
        docs = docs.mapInArrow(functools.partial(_clean, m), schema)
    return docs


def _clean(shared, batches):
    matcher = shared.value
    for b in batches_of(batches, "text"):
        doc, _, _ = matcher.batch(*_flat(b)) if matcher else (np.zeros(0, np.int64),) * 3
        keep = np.ones(b.num_rows, dtype=bool)
        keep[doc] = False
        if keep.any():
            yield b.filter(pa.array(keep))
