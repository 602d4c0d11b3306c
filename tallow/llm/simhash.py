"""SimHash fingerprints, and their components under a Hamming bound, by a Gray-order hierarchical index.

Each distinct fingerprint is written once however many documents have it. By the pigeonhole rule, two fingerprints with at
most `bits` differences agree on at least `AGREE` of `bits + AGREE` blocks of the 64 bits, so every choice of AGREE blocks routes
fingerprints to groups by the values there, and each link lies whole in some group. Inside a group fingerprints stand in Gray
order, where neighbours differ in few bits. Runs of neighbours form nodes with the bits that all members share (a mask and a
value), and runs of nodes form upper nodes. A pair of nodes is cut off when their shared bits differ too often, and joined
whole, without looking at its pairs, when even their differences and open bits together stay within the bound. A group
answers with a star to each local component's smallest member, so links out of a group never outnumber its rows. A group too large
for one task is split into ranges of Gray rank, and the pairs of ranges that the masks don't cut off become tasks.
Stars then shrink to components by alternating large-star and small-star rounds, each written to the shared folder.

Links by similarity (first_of_each_group) begin with the same index: sets of shingles have fingerprints, those within the bound are candidates, and what
has the similarity by its shingles is linked. Fingerprints of sets at the similarity may differ in more bits, so the links that they miss are then found exactly, by prefixes. Distinct shingles are counted over the distinct sets; each set's shingles
stand in order of (sets that have it, hash). Of a pair at the similarity or more, both sets hold a common shingle among their first n - ceil(similarity n) + 1.
A shingle that one set alone has can't be shared, so only sets whose first ones reach into repeated shingles go on, with their repeated
shingles, which also suffice to verify. In linking rounds after the fingerprints' each set meets, under each of its first shingles, the set with the largest share of repeated shingles and
its neighbours in an order by hash, a number of pairs that is linear in the sets; what these link is one component. Then sets of different components under a
shingle are compared where they are, in chunk pairs if many share it, by parity sketches: bit k is the parity of the shingles that hash to k, so the bits in which two
sketches differ never outnumber the shingles in which the sets differ. Only pairs that this leaves possible come out, and are verified by blocks of sets that
share their most frequent shingle.

Nulls: a null text has no words: fingerprint zero, which links like any other. A null doc_id keeps its fingerprint and can be no
component's id unless the whole component is null. Repeated rows count once in components. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, bound_arrow, map_arrow, materialize, mix64, only, ragged, scratch, signed

BITS = 4
AGREE = 2
SHINGLE = 4
SEED = 42
SIMILARITY = 0.8
#: Shingles that one task counts at once; sets with one shingle that are compared at once; sets and shingles of a block of sets.
PART_SHINGLES = 8_000_000
#: Bits of the part in a shingle's id; the other 40 are of its hash.
PART_BITS = 24
#: A shingle with about so many occurrences (a millionth of all, if that is more), found in a sample of one row in SAMPLE, isn't dealt to one task.
HOT_SHINGLE = 1 << 20
SAMPLE = 64
PREFIX_ROWS = 1_000
BLOCK_ROWS = 1_000
BLOCK_SHINGLES = 300_000
#: Rounds of linking, and orders by hash in each.
LINKING = 2
ORDERS = 4
#: Bits of the smallest and the largest parity sketch.
SKETCH_BITS = (256, 16_384)
#: Rows of a group that one task compares; larger groups are split by Gray rank.
GROUP_ROWS = 20_000
#: Members of a lowest node, and nodes of an upper node.
FAN = 16


def _shingles(words: Words, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles in text order, and how many each text has."""
    counts, offsets = words.counts, words.offsets
    # the batch's words, one space apart, hold every shingle as a slice
    lens = np.fromiter(map(len, words.vocab), dtype=np.int64, count=len(words.vocab))[words.codes] if words.vocab else np.zeros(0, dtype=np.int64)
    vocab = words.vocab
    whole = b" ".join([vocab[c] for c in words.codes.tolist()])
    begins = np.cumsum(lens + 1) - (lens + 1)
    n = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + offsets[doc]
    last = np.minimum(first + shingle, offsets[doc + 1]) - 1
    digest = xxhash.xxh64_intdigest
    ends = (begins[last] + lens[last]).tolist() if len(doc) else []
    return np.array([digest(whole[a:e], seed) for a, e in zip(begins[first].tolist() if len(doc) else [], ends, strict=True)], dtype=np.uint64), n


def _distinct(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles, in order, how many each text has, and a hash of each text's set."""
    words = Words(texts, lower=True)
    n = np.where(words.counts == 0, 0, np.maximum(words.counts - shingle + 1, 1))
    doc = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + words.offsets[doc]
    hashes = Rolling(words.mapped(lambda w: xxhash.xxh64_intdigest(w, SEED))).spans(first, np.minimum(shingle, words.counts[doc]))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, n = hashes[new], np.bincount(doc[new], minlength=len(n))
    ends = np.cumsum(n).tolist()
    c = [xxhash.xxh64_intdigest(hashes[e - k : e].tobytes()) for e, k in zip(ends, n.tolist(), strict=True)]
    return hashes, n, np.array(c, dtype=np.uint64)


def _majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of each text's n hashes."""
    fp = np.zeros(len(n), dtype=np.uint64)
    full = n > 0
    if full.any():
        starts = (np.cumsum(n) - n)[full]
        for k in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(1), starts)
            fp[full] |= (ones * np.uint64(2) > n[full].astype(np.uint64)).astype(np.uint64) << np.uint64(k)
    return fp


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (signed long) of each document; bit k is set if it is set in over half of the shingles' hashes."""
    bound_arrow(docs.sparkSession)

    def run(b: pa.RecordBatch) -> dict:
        hashes, n = _shingles(Words(b.column("text"), lower=True), shingle, seed)
        return {"doc_id": b.column("doc_id"), "fp": pa.array(signed(_majority(hashes, n)))}

    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_arrow(rows, run, "doc_id bigint, fp bigint", "text", 4 << 20)


def set_hashes(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, tk (hash of the text), c (hash of its set of shingles), n, the set's size, and fp, the set's fingerprint."""
    bound_arrow(docs.sparkSession)

    def run(b: pa.RecordBatch) -> dict:
        hashes, n, c = _distinct(b.column("text"), shingle)
        return {"doc_id": b.column("doc_id"), "tk": b.column("tk"), "c": pa.array(signed(c)), "n": pa.array(n.astype(np.int64)), "fp": pa.array(signed(_majority(hashes, n)))}

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")
    return map_arrow(rows, run, "doc_id bigint, tk bigint, c bigint, n bigint, fp bigint", "text", 4 << 20)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each pattern in the reflected Gray sequence."""
    x = x.astype(np.uint64, copy=True)
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class _Sets:
    """Union-find over positions; the root is the smallest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                return up
            up = self.up = nxt


class GrayTree:
    """Nodes over fingerprints in Gray order. Level 0 has FAN members a node, each further level FAN nodes."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        both, some = fps, fps
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (bits set in all, bits set in any)
        while True:
            cuts = np.arange(0, len(both), FAN)
            both, some = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(some, cuts)
            self.levels.append((both, some))
            if len(both) == 1:
                break

    def linked(self, other: GrayTree, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs that suffice to link all pairs within the bound (pairs of whole groups give a spanning set)."""
        same = self is other
        top = max(len(self.levels), len(other.levels))
        level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
        a, b = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        left, right = [], []
        for k in range(top - 1, -1, -1):
            (ba, sa), (bb, sb) = level(self, k), level(other, k)
            differ = (ba[a] & ~sb[b]) | (bb[b] & ~sa[a])
            open_ = (sa[a] & ~ba[a]) | (sb[b] & ~bb[b])
            least = np.bitwise_count(differ)
            most = np.bitwise_count(differ | open_)
            whole = most <= bits
            for x, y in zip(a[whole].tolist(), b[whole].tolist(), strict=True):
                la, lb = self._span(k, x), other._span(k, y)
                left += [np.full(lb[1] - lb[0], la[0]), np.arange(*la)]
                right += [np.arange(*lb), np.full(la[1] - la[0], lb[0])]
            keep = (least <= bits) & ~whole
            a, b = a[keep], b[keep]
            if k:
                a, b = self._children(a, b, len(level(self, k - 1)[0]), len(level(other, k - 1)[0]), k < len(self.levels), k < len(other.levels))
                if same:
                    ok = a <= b
                    a, b = a[ok], b[ok]
        for lo in range(0, len(a), 4096):  # lowest nodes: members against members
            x, y = self._children(a[lo : lo + 4096], b[lo : lo + 4096], len(self.fps), len(other.fps), True, True)
            near = np.bitwise_count(self.fps[x] ^ other.fps[y]) <= bits
            left.append(x[near])
            right.append(y[near])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2

    def _span(self, k: int, node: int) -> tuple[int, int]:
        k = min(k, len(self.levels) - 1)
        width = FAN ** (k + 1)
        return node * width, min((node + 1) * width, len(self.fps))

    @staticmethod
    def _children(a, b, n_a, n_b, split_a, split_b):
        fa, fb = FAN if split_a else 1, FAN if split_b else 1
        i, j = np.divmod(np.arange(fa * fb), fb)
        x, y = (a[:, None] * fa + i).ravel(), (b[:, None] * fb + j).ravel()
        ok = (x < n_a) & (y < n_b)
        return x[ok], y[ok]


def _small_groups(keys: np.ndarray, fps: np.ndarray, bits: int):
    """Pairs within the bound among rows with one key; rows stand in order of keys."""
    for d in range(1, len(keys)):
        i = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(i):
            return
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= bits]
        yield i, i + d


SMALL = 32


def _stars(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest linked member's fingerprint) inside each key's rows."""
    order = np.lexsort((gray_rank(fps), keys))
    keys, fps = keys[order], fps[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(cuts, len(keys)))
    sets = _Sets(len(keys))
    small = np.repeat(sizes <= SMALL, sizes) & (np.repeat(sizes, sizes) > 1)
    at = np.flatnonzero(small)
    pairs = [(at[i], at[j]) for i, j in _small_groups(keys[at], fps[at], bits)] if len(at) else []
    for c, n in zip(cuts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        tree = GrayTree(fps[c : c + n])
        i, j = tree.linked(tree, bits)
        pairs.append((i + c, j + c))
    return _joined(sets, pairs, fps)


def _joined(sets: _Sets, pairs, fps) -> tuple[np.ndarray, np.ndarray]:
    if pairs:
        i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        # repeated minimum over edges, then the few edges left by union-find
        for _ in range(3):
            r = sets.roots()
            a, b = r[i], r[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            np.minimum.at(sets.up, np.maximum(a, b), np.minimum(a, b))
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            sets.join(x, y)
    r = sets.roots()
    moved = np.flatnonzero(r != np.arange(len(r)))
    return fps[moved], fps[r[moved]]


def blocks_of(bits: int) -> list[int]:
    """Masks of bits + AGREE blocks that make up the 64 bits."""
    n = bits + AGREE
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) of fingerprints whose closure links all pairs of `distinct.fp` with at most `bits` different bits."""
    masks = [sum(c) for c in itertools.combinations(blocks_of(bits), AGREE)]

    def route(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for k, m in enumerate(masks):
                key = mix64((fp & np.uint64(m)) ^ np.uint64((k * 0xA24BAED4963EE407 + 1) & (1 << 64) - 1))
                yield pa.RecordBatch.from_pydict({"key": pa.array(signed(key)), "fp": b.column("fp")})

    return _links_in_groups(distinct.mapInArrow(route, "key bigint, fp bigint"), bits, GROUP_ROWS)


def _links_in_groups(routed: DataFrame, bits: int, group_rows: int) -> DataFrame:
    spark = routed.sparkSession
    # groups that one task shouldn't hold: found by counts that are added up before the shuffle
    large = materialize(routed.groupBy("key").count().where(F.col("count") > group_rows), "simhash-large")
    any_large = bool(large.take(1))
    plain = routed.join(large.select("key"), "key", "left_anti") if any_large else routed
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = plain.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda it: _compare(it, bits), "a bigint, b bigint")
    if any_large:
        edges = edges.unionByName(_large_links(routed.join(large, "key"), bits, group_rows))
    return edges.distinct()


def _compare(batches, bits: int):
    """Rows come in order of keys; whole groups are compared once their last row is in."""
    keys, fps, held = [], [], 0
    for b in batches:
        if not b.num_rows:
            continue
        keys.append(b.column("key").to_numpy())
        fps.append(b.column("fp").to_numpy().view(np.uint64))
        held += b.num_rows
        if held < 200_000:
            continue
        k, f = np.concatenate(keys), np.concatenate(fps)
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if cut:
            yield _edges(*_stars(k[:cut], f[:cut], bits))
        keys, fps, held = [k[cut:]], [f[cut:]], len(k) - cut
    if held:
        yield _edges(*_stars(np.concatenate(keys), np.concatenate(fps), bits))


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(signed(a)), "b": pa.array(signed(b))})


def _large_links(rows: DataFrame, bits: int, group_rows: int) -> DataFrame:
    """A large group's ranges of Gray rank; pairs of ranges that their shared bits don't keep apart are compared in a task each."""
    spark = rows.sparkSession
    ranked = rows.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"key": b.column("key"), "fp": b.column("fp"), "rank": pa.array(signed(gray_rank(b.column("fp").to_numpy().view(np.uint64)) ^ np.uint64(1 << 63)))}) for b in it), "key bigint, fp bigint, rank bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(ranked.repartitionByRange(parts, "key", "rank").sortWithinPartitions("key", "rank").withColumn("at", F.monotonically_increasing_id()).withColumn("chunk", F.floor(F.col("at") / group_rows)).drop("at", "rank"), "simhash-chunks")
    chunks = cut.groupBy("key", "chunk").agg(F.bit_and("fp").alias("both"), F.bit_or("fp").alias("some"))
    x, y = chunks.alias("x"), chunks.alias("y")
    differ = F.bit_count((F.col("x.both").bitwiseAND(F.bitwise_not("y.some"))).bitwiseOR(F.col("y.both").bitwiseAND(F.bitwise_not("x.some"))))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.chunk") <= F.col("y.chunk")) & (differ <= bits)).select(F.col("x.key").alias("key"), F.col("x.chunk").alias("i"), F.col("y.chunk").alias("j"))
    tasks = pairs.select("key", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("chunk"))

    def compare(_key, t: pa.Table) -> pa.Table:
        chunk = t.column("chunk").to_numpy()
        fps = t.column("fp").to_numpy().view(np.uint64)
        own = np.zeros(len(fps), dtype=np.uint64)  # one group; pairs inside a chunk recur, which does no harm
        a, b = _stars(own[: len(np.unique(fps))], np.unique(fps), bits) if len(chunk) else (fps[:0], fps[:0])
        return pa.table({"a": pa.array(signed(a)), "b": pa.array(signed(b))})

    return tasks.join(cut, ["key", "chunk"]).groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a smaller node in its component, by large-star and small-star rounds."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the joins' sides are plain shuffles, which adaptive execution splits at a star's centre
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "stars-low")
        # large star: each larger neighbour links to the smallest
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where("a <> m").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        large = materialize(large, "stars")
        # small star: each node and its smaller neighbours link to the smallest of them
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "stars-low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        nxt = materialize(small, "stars")
        # done when each node has one link, to a node that has none
        several = nxt.groupBy("a").count().where("count > 1")
        chained = nxt.select(F.col("b").alias("a")).join(nxt.select("a"), "a", "left_semi")
        if not several.take(1) and not chained.take(1):
            return nxt.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = nxt


def classes(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """fp and root, the smallest fingerprint that chains of links reach, of each distinct fingerprint in a written table."""
    distinct = materialize(fps.groupBy("fp").agg(F.count("*").alias("n")), "fingerprints-distinct").select("fp")
    roots = components(links(distinct, bits))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that chains of links reach."""
    with scratch(docs.sparkSession) as keep:
        fps = keep(materialize(fingerprints(docs, shingle), "fingerprints"))
        firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
        found = materialize(firsts.join(classes(fps, bits), "fp"), "simhash-found")
        ids = materialize(found.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-ids")
        # one row a fingerprint; a fingerprint that many documents have is a hot key, which adaptive skew joins split
        of = keep(materialize(found.join(ids, "root").select("fp", "component_id"), "simhash-classes"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def repeated_shingles(docs: DataFrame, shingle: int, total: int) -> DataFrame:
    """c, and lists of ids (64-bit) and counts (32-bit) of the shingles of set c that other sets have too; several rows a set."""
    parts = 1 << max(6, (total // PART_SHINGLES).bit_length())
    if parts > 1 << PART_BITS:
        raise ValueError(f"{total} shingles are more than ids of 64 bits can tell apart")
    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs, shingle, max(HOT_SHINGLE, total >> 20)))

    def deal(b: pa.RecordBatch) -> dict:
        hashes, n, c = _distinct(b.column("text"), shingle)
        doc = np.repeat(np.arange(len(n)), n)
        usual = ~_among(hashes, hot.value[0])[0]
        hashes, doc = hashes[usual], doc[usual]
        part = (hashes & np.uint64(parts - 1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, doc = part[order], doc[order]
        tops = (hashes[order] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
        runs = _starts(part, doc)
        many = np.diff(np.append(runs, len(part))).astype("<u4").tobytes()
        sets = c[doc[runs]].tobytes()
        own, at = np.unique(part, return_index=True)
        at, of = np.append(at, len(part)).tolist(), np.append(np.searchsorted(part[runs], own), len(runs)).tolist()
        cut = lambda data, edges, width: pa.array([data[width * i : width * j] for i, j in itertools.pairwise(edges)], pa.binary())
        return {"part": pa.array(own.astype(np.int32)), "c": cut(sets, of, 8), "many": cut(many, of, 4), "tops": cut(tops, at, 5)}

    def count(t: pa.Table) -> pa.Table:
        whole = lambda name: b"".join(t.column(name).to_pylist())
        raw = np.frombuffer(whole("tops"), np.uint8).reshape(-1, 5)
        h = np.zeros((len(raw), 8), dtype=np.uint8)
        h[:, :5] = raw
        h = h.view("<u8").ravel()
        c = np.repeat(np.frombuffer(whole("c"), np.int64), np.frombuffer(whole("many"), "<u4"))
        order = np.argsort(h)
        h, c = h[order], c[order]
        again = np.zeros(len(h), dtype=bool)
        again[1:] = h[1:] == h[:-1]
        again[:-1] |= again[1:]
        h, c = h[again], c[again]
        # a text that occurs twice counts once
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        once = _starts(h, c)
        h, c = h[once], c[once]
        n = np.diff(np.append(_starts(h), len(h)))
        n = np.repeat(n, n)
        order = np.flatnonzero(n > 1)
        order = order[np.argsort(c[order], kind="stable")]
        part = t.column("part")[0].as_py()
        c, ids, n = c[order], (h[order] << np.uint64(PART_BITS) | np.uint64(part)).tobytes(), n[order].astype("<u4").tobytes()
        edges = np.append(_starts(c), len(c)).tolist()
        cut = lambda data, width: pa.array([data[width * i : width * j] for i, j in itertools.pairwise(edges)], pa.binary())
        return pa.table({"c": pa.array(c[edges[:-1]]), "ids": cut(ids, 8), "counts": cut(n, 4)})

    def own(b: pa.RecordBatch) -> dict:
        """Each set's hot shingles, under the ids that they would have in their parts."""
        hashes, n, c = _distinct(b.column("text"), shingle)
        doc = np.repeat(np.arange(len(n)), n)
        found, at = _among(hashes, hot.value[0])
        doc, counts = doc[found], hot.value[1][at[found]].astype("<u4")
        ids = hashes[found] >> np.uint64(PART_BITS) << np.uint64(PART_BITS) | hashes[found] & np.uint64(parts - 1)
        edges = np.searchsorted(doc, np.arange(len(n) + 1)).tolist()
        some = [k for k in range(len(n)) if edges[k + 1] > edges[k]]
        cut = lambda data, width: pa.array([data[width * edges[k] : width * edges[k + 1]] for k in some], pa.binary())
        return {"c": pa.array(c.view(np.int64)[some]), "ids": cut(ids.tobytes(), 8), "counts": cut(counts.tobytes(), 4)}

    dealt = map_arrow(only(docs, "text"), deal, "part int, c binary, many binary, tops binary", "text", 4 << 20)
    repeated = dealt.groupBy("part").applyInArrow(count, "c bigint, ids binary, counts binary")
    if not len(hot.value[0]):
        return repeated
    # a set's own row, once however many texts have the set
    mine = map_arrow(only(docs, "text"), own, "c bigint, ids binary, counts binary", "text", 4 << 20).groupBy("c").agg(F.first("ids").alias("ids"), F.first("counts").alias("counts"))
    return repeated.unionByName(mine)


def _among(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which hashes are wanted, where they are in wanted), wanted being sorted."""
    at = np.searchsorted(wanted, hashes)
    at[at == len(wanted)] = 0
    return (wanted[at] == hashes if len(wanted) else np.zeros(len(hashes), dtype=bool)), at


def hot_shingles(docs: DataFrame, shingle: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and estimated counts of the shingles that some `least` rows hold, by a sample of rows. All that rests on the sample is which way a shingle goes and its place
    in the order of rarity, not the result. They are at most the corpus' shingles divided by `least`, about: a million."""

    def count(b: pa.RecordBatch) -> dict:
        hashes, n = np.unique(_distinct(b.column("text"), shingle)[0], return_counts=True)
        return {"h": pa.array(signed(hashes)), "n": pa.array(n.astype(np.int64))}

    some = only(docs, "doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0).select("text")
    found = map_arrow(some, count, "h bigint, n bigint", "text").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, least // SAMPLE)).collect()
    h, n = np.array([r.h for r in found], dtype=np.int64).view(np.uint64), np.array([r.n for r in found], dtype=np.int64) * SAMPLE
    order = np.argsort(h)
    return h[order], np.minimum(n[order], (1 << 32) - 1)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new)


def possible_sets(repeated: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """c, n, ids (repeated shingles, rarest first), first (how many of them may link the set), alone (how many of its shingles no other set has), sketch and block, of
    the sets that can be in a link at all."""
    spark = repeated.sparkSession

    def order(b: pa.RecordBatch) -> dict:
        rows = []
        for c, n, lists in zip(b.column("c").to_pylist(), b.column("n").to_pylist(), b.column("lists").to_pylist(), strict=True):
            ids = np.frombuffer(b"".join([x["ids"] for x in lists]), np.uint64)
            first = len(ids) - int(np.ceil(similarity * n - 1e-9)) + 1
            if first > 0:
                ids = ids[np.lexsort((ids, np.frombuffer(b"".join([x["counts"] for x in lists]), "<u4")))]
                rows.append((c, n, ids.tobytes(), first, int(ids[-1].view(np.int64))))
        return {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("c", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("first", pa.int64()), ("last", pa.int64())))}

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict(order(b))

    def block(batches):
        at, rows, size = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            blocks = []
            for n in pc.binary_length(b.column("ids")).to_pylist():
                if rows and (rows == BLOCK_ROWS or size + n // 8 > BLOCK_SHINGLES):
                    at, rows, size = at + 1, 0, 0
                rows, size = rows + 1, size + n // 8
                blocks.append(at)
            ids = b.column("ids").to_pylist()
            sketches = [parity_sketch(np.frombuffer(x, np.uint64), sketch_bits(n)) for x, n in zip(ids, b.column("n").to_pylist(), strict=True)]
            more = {"alone": pc.subtract(b.column("n"), pa.array([len(x) // 8 for x in ids], pa.int64())), "sketch": pa.array(sketches, pa.binary()), "block": pa.array(blocks, pa.int64())}
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in ("c", "n", "ids", "first")} | more)

    lists = repeated.groupBy("c").agg(F.collect_list(F.struct("ids", "counts")).alias("lists")).join(sizes, "c").select("c", "n", "lists")
    found = materialize(lists.mapInArrow(run, "c bigint, n bigint, ids binary, first bigint, last bigint"), "simhash-possible")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartitionByRange(parts, "last", "c").sortWithinPartitions("last", "c")
    return materialize(dealt.mapInArrow(block, "c bigint, n bigint, ids binary, first bigint, alone bigint, sketch binary, block bigint"), "simhash-blocks")


def sketch_bits(n: int) -> int:
    """A power of two, at least twice the set's size within SKETCH_BITS."""
    return min(max(SKETCH_BITS[0], 1 << (2 * n - 1).bit_length()), SKETCH_BITS[1])


def parity_sketch(ids: np.ndarray, bits: int) -> bytes:
    """Bit k is the parity of the ids whose mixed value is k modulo `bits`; the two halves' difference is the sketch of half the bits."""
    at = mix64(ids) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


class Sketches:
    """The sketches of a group's sets, of one or two neighbouring sizes at a time."""

    def __init__(self, sketches: list[bytes]):
        self.sketches = sketches
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def differ(self, x: int, ys: np.ndarray) -> np.ndarray:
        """The bits in which the sketches of ys, folded to the size of x's, differ from it; no y is smaller."""
        size = len(self.sketches[x])
        if size not in self.tables:
            rows, of = [], np.full(len(self.sketches), -1)
            for k, b in enumerate(self.sketches):
                v = np.frombuffer(b, np.uint64)
                while len(v) * 8 > size:
                    v = v[: len(v) // 2] ^ v[len(v) // 2 :]
                if len(v) * 8 == size:
                    of[k] = len(rows)
                    rows.append(v)
            self.tables[size] = (np.stack(rows), of)
        table, of = self.tables[size]
        return np.bitwise_count(table[of[ys]] ^ table[of[x]]).sum(1, dtype=np.int64)


def first_shingles(possible: DataFrame) -> DataFrame:
    """h, c, n and share (of repeated shingles in the set, in millionths): a row for each shingle that may link a set."""

    def run(batches):
        for b in batches:
            first, n = b.column("first").to_numpy(), b.column("n").to_numpy()
            ids = b"".join([x[: 8 * k] for x, k in zip(b.column("ids").to_pylist(), first.tolist(), strict=True)])
            share = 1_000_000 - b.column("alone").to_numpy() * 1_000_000 // n
            yield pa.RecordBatch.from_pydict({"h": pa.array(np.frombuffer(ids, np.int64)), "c": pa.array(np.repeat(b.column("c").to_numpy(), first)), "n": pa.array(np.repeat(n, first)), "share": pa.array(np.repeat(share, first))})

    return possible.select("c", "n", "ids", "first", "alone").mapInArrow(run, "h bigint, c bigint, n bigint, share bigint")


PAIRS = "x bigint, y bigint"


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """The distinct pairs, the smaller member first."""
    x, y = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    keep = _starts(x, y)
    return pa.RecordBatch.from_pydict({"x": pa.array(x[keep]), "y": pa.array(y[keep])})


def linking_pairs(rooted: DataFrame, similarity: float, seed: int) -> DataFrame:
    """Pairs of sets of different components under a shingle: each with the one that has the largest share of repeated shingles, and with the next one in an order by hash (one of ORDERS orders, by
    the shingle, so that a family's sets meet a few others each). rooted: h, c, n, share, root."""

    def run(batches):
        last = np.zeros((4, 0), dtype=np.int64)
        for b in batches:
            h, c, n, root = np.concatenate([last, np.stack([b.column(k).to_numpy() for k in ("h", "c", "n", "root")])], axis=1)
            at = np.flatnonzero((h[1:] == h[:-1]) & (root[1:] != root[:-1]) & (np.minimum(n[1:], n[:-1]) >= np.maximum(n[1:], n[:-1]) * similarity - 1e-9))
            yield _pairs(c[at], c[at + 1])
            last = np.stack([x[-1:] for x in (h, c, n, root)])

    parts = int(rooted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # in ranges, so that a very common shingle fills several tasks; a pair lost between two ranges is found later
    order = F.xxhash64("c", F.pmod("h", F.lit(ORDERS)), F.lit(seed))
    ranged = rooted.withColumn("at", order).repartitionByRange(parts, "h", "at", "c").sortWithinPartitions("h", "at", "c")
    near = ranged.select("h", "c", "n", "root").mapInArrow(run, PAIRS)
    pivots = materialize(rooted.groupBy("h").agg(F.max(F.struct("share", "c", "n", "root")).alias("p"), F.count("*").alias("many")).where("many > 1").select("h", "p.c", "p.n", "p.root").toDF("h", "pc", "pn", "proot"), "simhash-pivots")
    sizes = F.least("n", "pn") >= F.greatest("n", "pn") * similarity - 1e-9
    central = rooted.join(pivots, "h").where((F.col("root") != F.col("proot")) & sizes).select(F.least("c", "pc").alias("x"), F.greatest("c", "pc").alias("y"))
    return near.unionByName(central).distinct()


def fingerprint_pairs(marked: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (x, y) of sets whose fingerprints link at the bound: the smallest sets of linked fingerprints, and each set with the smallest of its own fingerprint. marked: c, fp."""
    firsts = materialize(marked.groupBy("fp").agg(F.min("c").alias("first")), "simhash-firsts")
    own = marked.join(firsts, "fp").where("c <> first").select("c", "first")
    edges = materialize(links(firsts.select("fp"), bits), "simhash-edges")
    linked = edges.join(firsts.toDF("a", "x"), "a").join(firsts.toDF("b", "y"), "b").select("x", "y").where("x <> y")
    return linked.unionByName(own.toDF("x", "y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def with_roots(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Adds root, the component by the links so far, as a written table."""
    roots = components(links).toDF("c", "root")
    return materialize(rows.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c")), "simhash-rooted")


def _cells():
    """Where a set under a shingle meets others: cells (i, j) of two chunks, and its own side. Sets of the shingle's top component, in `inside` chunks, meet those outside of it; these, in `outside`
    chunks, meet each other too. So rows are as many as the sets times the chunks of the others, and about the sets alone where few are outside."""
    numbers = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    cell = lambda i, j, own: F.struct(i.alias("i"), j.alias("j"), own.alias("own"))
    within, beyond = F.pmod(F.xxhash64("c"), "inside"), F.pmod(F.xxhash64("c"), "outside")
    top = F.transform(numbers(F.col("outside")), lambda k: cell(-1 - within, k, F.lit(-1).cast("bigint")))
    others = F.concat(F.transform(numbers(F.col("inside")), lambda k: cell(-1 - k, beyond, beyond)), F.transform(numbers(F.col("outside")), lambda k: cell(F.least(beyond, k), F.greatest(beyond, k), beyond)))
    return F.when(F.col("root") == F.col("top"), top).otherwise(others)


def pairs_across(rooted: DataFrame, possible: DataFrame, similarity: float) -> DataFrame:
    """All pairs of sets with a common shingle in rooted (h, c, n, root) whose components differ, and whose sizes and sketches allow a link."""
    # of each shingle's sets, those of the component that most of them are in never meet each other
    roots = rooted.groupBy("h", "root").agg(F.count("*").alias("many"))
    shared = roots.groupBy("h").agg(F.sum("many").alias("many"), F.max(F.struct("many", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    chunks = lambda n: F.ceil(n / PREFIX_ROWS)
    shared = materialize(shared.select("h", F.col("top.root").alias("top"), chunks(F.col("top.many")).alias("inside"), chunks(F.col("many") - F.col("top.many")).alias("outside")), "simhash-shared")
    rooted = rooted.join(shared, "h").join(possible.select("c", "alone", "sketch"), "c")
    dealt = rooted.withColumn("cell", F.explode(_cells())).select("h", "cell.i", "cell.j", "cell.own", "c", "n", "root", "alone", "sketch")
    columns = ("h", "i", "j", "own", "c", "n", "root", "alone")
    apart = (1 - similarity) / (1 + similarity)

    def meet(rows, sketches):
        h, i, j, own, c, n, root, alone = rows
        cuts = _starts(h, i, j)
        left, right, held = [c[:0]], [c[:0]], 0
        for a, e in itertools.pairwise(np.append(cuts, len(h)).tolist()):
            if e - a < 2 or (root[a:e] == root[a]).all():
                continue
            order = a + np.argsort(n[a:e], kind="stable")
            group = Sketches([sketches[k] for k in order.tolist()])
            sizes, roots, mine, lone = n[order], root[order], own[order], alone[order]
            last = np.searchsorted(sizes, sizes / similarity + 1e-9, side="right")
            whole = i[a] == j[a]
            for k in range(len(order) - 1):
                ys = np.arange(k + 1, last[k])
                ys = ys[(roots[ys] != roots[k]) & (whole | (mine[ys] != mine[k]))]
                if not len(ys):
                    continue
                ys = ys[group.differ(k, ys) + lone[k] + lone[ys] <= (sizes[k] + sizes[ys]) * apart + 1e-9]
                left.append(np.full(len(ys), c[order[k]]))
                right.append(c[order[ys]])
                held += len(ys)
            if held > 1_000_000:
                yield _pairs(np.concatenate(left), np.concatenate(right))
                left, right, held = [c[:0]], [c[:0]], 0
        yield _pairs(np.concatenate(left), np.concatenate(right))

    def run(batches):
        held, sketches = [], []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.stack([b.column(k).to_numpy() for k in columns]))
            sketches += b.column("sketch").to_pylist()
            if len(sketches) < 20_000:
                continue
            rows = np.concatenate(held, axis=1)
            cut = int(_starts(*rows[:3])[-1])
            if cut:
                yield from meet(rows[:, :cut], sketches[:cut])
            held, sketches = [rows[:, cut:]], sketches[cut:]
        if held:
            yield from meet(np.concatenate(held, axis=1), sketches)

    parts = int(rooted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(run, PAIRS).distinct()


def verified(pairs: DataFrame, possible: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of pairs (x, y) whose sets have the similarity or more."""
    of = possible.select("c", "block")
    pairs = materialize(pairs.join(of.toDF("x", "i"), "x").join(of.toDF("y", "j"), "y"), "simhash-pairs")
    members = pairs.select(F.col("i").alias("k"), F.col("j").alias("l"), F.explode(F.array("x", "y")).alias("c")).distinct().join(possible.select("c", "n", "ids"), "c")

    def test(p: pa.Table, s: pa.Table) -> pa.Table:
        c, n = s.column("c").to_numpy(), s.column("n").to_numpy()
        ids = s.column("ids").to_pylist()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 8
        start = np.cumsum(size) - size
        own, code = np.unique(np.frombuffer(b"".join(ids), np.uint64), return_inverse=True)
        order = np.argsort(c)
        x, y = (order[np.searchsorted(c[order], p.column(k).to_numpy())] for k in ("x", "y"))
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        has = np.zeros(len(own), dtype=np.int64)
        common = np.zeros(len(x), dtype=np.int64)
        for lo, hi in itertools.pairwise(np.append(_starts(x), len(x)).tolist()):
            mine = code[start[x[lo]] : start[x[lo]] + size[x[lo]]]
            has[mine] = 1
            others = y[lo:hi]
            common[lo:hi] = np.add.reduceat(has[code[ragged(start[others], size[others])]], np.cumsum(size[others]) - size[others])
            has[mine] = 0
        ok = common >= similarity * (n[x] + n[y] - common)
        return pa.table({"a": pa.array(c[x[ok]]), "b": pa.array(c[y[ok]])})

    return materialize(pairs.groupBy("i", "j").cogroup(members.groupBy("k", "l")).applyInArrow(test, "a bigint, b bigint"), "simhash-links")


def similar_sets(docs: DataFrame, sizes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of every set of shingles that has a smaller one in its group; sizes holds c, n and fp of all distinct sets."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    possible = possible_sets(repeated_shingles(docs, shingle, total), sizes.select("c", "n"), similarity)
    # a set without a repeated shingle among its first ones is like no other, whatever its fingerprint
    marked = materialize(possible.select("c").join(sizes.select("c", "fp"), "c"), "simhash-marked")
    linked = verified(fingerprint_pairs(marked), possible, similarity)
    rows = first_shingles(possible)
    for k in range(LINKING):
        linked = linked.unionByName(verified(linking_pairs(with_roots(rows, linked), similarity, k), possible, similarity))
    return components(linked.unionByName(verified(pairs_across(with_roots(rows, linked), possible, similarity), possible, similarity)))


def first_of_each_group(docs: DataFrame, shingle: int, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, of which no other row of their group comes before: smallest doc_id, nulls last, then smallest
    text hash. Groups are chains of pairs whose sets of shingles have the Jaccard similarity or more; texts without words are alike."""
    keyed = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "_tk": F.xxhash64("text")})
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tk"))
    with scratch(docs.sparkSession) as keep:
        fps = materialize(set_hashes(docs, shingle), "fingerprints")
        sets = materialize(fps.groupBy("c").agg(first.alias("k"), F.first("n").alias("n"), F.first("fp").alias("fp")), "simhash-sets")
        roots = similar_sets(docs, sets.select("c", "n", "fp"), shingle, similarity).withColumnRenamed("node", "c")
        chosen = sets.join(roots, "c", "left").groupBy(F.coalesce("root", "c").alias("root")).agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.tk").alias("_k"))
        rows = fps.groupBy(F.col("doc_id").alias("_i"), F.col("tk").alias("_t")).agg(F.count("*").alias("_n"))
        kept = keep(materialize(chosen.join(rows, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_k") == F.col("_t"))).select("_id", "_k", "_n"), "simhash-kept"))
    found = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tk") == F.col("_k")))
    once = found.where("_n = 1").select(*docs.columns)
    repeated = found.where("_n > 1").groupBy("_id", "_k").agg(F.min(F.struct(*docs.columns)).alias("s")).select("s.*")
    return once.unionByName(repeated)


def hex_of(fp: str):
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
