"""Language-model scoring: a log-bilinear model over words, trained by noise-contrastive estimation.

Words (A-Z in lower case) and one end token a document are counted over all training documents. The most frequent words are units of their
own; their number grows with the corpus, as GROWTH times the cube root of its tokens. Every other word belongs, by its last letters, to one
of a quarter as many rare units, and the end token is a unit. Units stand in groups, about as many as a group has members.
The model sums the context's unit vectors, weighted by place, and multiplies them with the vectors of groups, and with those of the units of one group: a
unit's probability is its group's times its own inside the group. A word's is its unit's, times, in a rare unit, its smoothed share of the unit's
training tokens, (c + 0.5) / (N_unit + 0.5 (V_unit + 1)), so unknown words have their own share and all sums to one.

Training runs on all training documents, each once, in ROUNDS over slices of them, whatever the corpus's size. In a round each task starts from the shared
parameters and takes minibatches with noise drawn from the group counts, and from the unit counts inside each token's group. What a task changed
goes in slices of 16-bit floats to tasks that average them by tokens; the driver holds one model. Scoring needs no noise: both
normalisers are exact, by products of blocks of contexts with all group vectors, and with all vectors of a group.

Counts of words beyond the dictionary (all words from a count on, at most DICTIONARY) stay in Spark and are joined by hash.

Nulls: a null or empty text has the end token alone. Rows with null or repeated doc_ids are scored each on its own. Without training documents the
counts are empty and the score is the base. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, batches_of, bound_arrow, map_arrow, materialize, only, signed

#: Words with vectors of their own, for each cube root of the training tokens.
GROWTH = 8
#: Words whose counts the tasks hold, at most; the others' are joined.
DICTIONARY = 200_000
CONTEXT = 2
DIM = 32
#: Noise samples that a minibatch shares: of groups, and of units of each group.
NOISE = 16
OWN_NOISE = 16
BATCH = 4096
ROUNDS = 6
RATE = 0.1
#: Parts in which changed parameters travel.
SLICES = 16


class Units:
    """How many units there are, and how they stand in groups: unit u is member u % size of group u // size."""

    def __init__(self, words: int):
        self.head = words
        self.rare = max(16, words // 4)
        self.n = self.head + self.rare + 1
        self.end = self.n - 1
        self.size = int(np.ceil(np.sqrt(self.n)))
        self.groups = -(-self.n // self.size)

    def rare_unit(self, word: bytes) -> int:
        return self.head + zlib.crc32(word[-3:]) % self.rare


class Model:
    """Vectors and biases of groups and units, context vectors, and a weight vector for each place of the context. Each row of them keeps the sum of its squared
    gradients (its mean over the row), which slows its steps; the roots travel with the parameters."""

    NAMES = ("group_out", "group_bias", "out", "bias", "ctx", "place")

    def __init__(self, units: Units, counts: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.units = units
        groups, size = units.groups, units.size
        vectors = lambda n: rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
        self.group_out, self.out, self.ctx = vectors(groups), vectors(groups * size), vectors(groups * size)
        self.place = np.ones((CONTEXT, DIM), dtype=np.float32)
        padded = np.zeros(groups * size)
        padded[: units.n] = counts + 0.5
        table = padded.reshape(groups, size)
        total = table.sum(1)
        self.group_bias = np.log(total / total.sum()).astype(np.float32)
        with np.errstate(divide="ignore"):
            self.bias = np.maximum(np.log(table / total[:, None]), -1e4).astype(np.float32).ravel()  # places without a unit have no share
        self.squares = {n: np.ones(len(getattr(self, n)), dtype=np.float32) for n in self.NAMES}

    def pack(self) -> np.ndarray:
        return np.concatenate([*[getattr(self, n).ravel() for n in self.NAMES], *[np.sqrt(self.squares[n]) for n in self.NAMES]])

    def unpacked(self, flat: np.ndarray) -> Model:
        """A model of the same shape with these parameters."""
        m, at = Model.__new__(Model), 0
        m.units = self.units
        for name in self.NAMES:
            x = getattr(self, name)
            setattr(m, name, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        m.squares = {}
        for name in self.NAMES:
            n = len(getattr(self, name))
            m.squares[name] = (flat[at : at + n] ** 2).astype(np.float32)
            at += n
        return m

    def query(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.ctx[one] * self.place[0] + self.ctx[two] * self.place[1]

    def log_p(self, tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log-probability of each unit after its context."""
        order = np.argsort(tokens)
        tokens, q, size = tokens[order], self.query(one[order], two[order]), self.units.size
        group = tokens // size
        log = _normalised(q @ self.group_out.T + self.group_bias, group)
        cuts = np.searchsorted(group, np.arange(self.units.groups + 1))
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            at, s = slice(cuts[g], cuts[g + 1]), slice(g * size, (g + 1) * size)
            log[at] += _normalised(q[at] @ self.out[s].T + self.bias[s], tokens[at] - g * size)
        out = np.empty(len(tokens))
        out[order] = log
        return out


def _normalised(scores: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    own = scores[np.arange(len(chosen)), chosen]
    with np.errstate(over="ignore"):
        total = np.exp(scores).sum(1)
    if np.isfinite(total).all() and total.min(initial=1.0) > 0:
        return own - np.log(total)
    top = scores.max(1)
    return own - top - np.log(np.exp(scores - top[:, None]).sum(1))


class Noise:
    """Distributions that noise is drawn from: of groups, and of units inside each group."""

    def __init__(self, units: Units, counts: np.ndarray):
        groups, size = units.groups, units.size
        padded = np.zeros(groups * size)
        padded[: units.n] = (counts + 0.5) ** 0.75
        table = padded.reshape(groups, size)
        total = table.sum(1)
        p = total / total.sum()
        self.group_edges, self.group_log = np.cumsum(p), np.log(NOISE * p).astype(np.float32)
        own = table / total[:, None]
        self.edges = (np.cumsum(own, axis=1) + np.arange(groups)[:, None]).ravel()
        self.log = np.log(OWN_NOISE * np.maximum(own, 1e-30)).astype(np.float32).ravel()
        self.last = np.minimum((np.arange(groups) + 1) * size, units.n) - 1

    def of_groups(self, rng) -> np.ndarray:
        return np.minimum(np.searchsorted(self.group_edges, rng.random(NOISE)), len(self.group_edges) - 1)

    def inside(self, groups: np.ndarray, rng) -> np.ndarray:
        """OWN_NOISE units of each of the groups."""
        return np.minimum(np.searchsorted(self.edges, groups[:, None] + rng.random((len(groups), OWN_NOISE)), side="right"), self.last[groups][:, None])


class Learner:
    """Noise-contrastive steps on a model."""

    def __init__(self, model: Model, noise: Noise, seed: int):
        self.model, self.noise, self.rng = model, noise, np.random.default_rng(seed)

    def learn(self, tokens: np.ndarray, begins: np.ndarray) -> None:
        m, noise = self.model, self.noise
        one, two = _context(tokens, begins, m.units.end)
        order = self.rng.permutation(len(tokens))
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            at = at[np.argsort(tokens[at])]  # units of a group stand together
            w, c1, c2 = tokens[at], one[at], two[at]
            x1, x2 = m.ctx[c1], m.ctx[c2]
            q = x1 * m.place[0] + x2 * m.place[1]
            group = w // m.units.size
            first = _runs(group)
            groups, other = group[first], noise.of_groups(self.rng)
            # groups against noise that the batch shares
            rn = m.group_out[other]
            own = m.group_out[group]
            good = 1 - _sigmoid((q * own).sum(1) + m.group_bias[group] - noise.group_log[group])
            bad = -_sigmoid(q @ rn.T + m.group_bias[other] - noise.group_log[other])
            gq = good[:, None] * own + bad @ rn
            self._step("group_out", groups, np.add.reduceat(good[:, None] * q, first))
            self._step("group_bias", groups, np.add.reduceat(good, first)[:, None])
            self._step("group_out", other, bad.T @ q)
            self._step("group_bias", other, bad.sum(0)[:, None])
            # units against noise that the batch's tokens of their group share
            near = noise.inside(groups, self.rng)
            own = m.out[w]
            good = 1 - _sigmoid((q * own).sum(1) + m.bias[w] - noise.log[w])
            gq += good[:, None] * own
            vectors, parts = m.out[near], list(zip(first.tolist(), [*first[1:].tolist(), len(w)], strict=True))
            bad = np.empty((len(w), OWN_NOISE), dtype=np.float32)
            for (a, e), v in zip(parts, vectors, strict=True):
                np.matmul(q[a:e], v.T, out=bad[a:e])
            bad = -_sigmoid(bad + np.repeat(m.bias[near] - noise.log[near], np.diff(np.append(first, len(w))), axis=0))
            slope = np.empty_like(vectors)
            for k, ((a, e), v) in enumerate(zip(parts, vectors, strict=True)):
                gq[a:e] += bad[a:e] @ v
                np.matmul(bad[a:e].T, q[a:e], out=slope[k])
            units = _runs(w)
            self._step("out", w[units], np.add.reduceat(good[:, None] * q, units))
            self._step("bias", w[units], np.add.reduceat(good, units)[:, None])
            self._step("out", near.ravel(), slope.reshape(-1, DIM))
            self._step("bias", near.ravel(), np.add.reduceat(bad, first).reshape(-1, 1))
            self._step("ctx", np.concatenate([c1, c2]), np.concatenate([gq * m.place[0], gq * m.place[1]]))
            self._step("place", np.arange(CONTEXT), np.stack([(gq * x1).sum(0), (gq * x2).sum(0)]))

    def _step(self, name: str, index: np.ndarray, rows: np.ndarray) -> None:
        """Adds up the rows of each index and moves those parameters alone."""
        if len(index) > 1 and not (index[1:] > index[:-1]).all():
            order = np.argsort(index)
            index, rows = index[order], rows[order]
            cuts = _runs(index)
            rows, index = np.add.reduceat(rows, cuts), index[cuts]
        p, squares = getattr(self.model, name), self.model.squares[name]
        squares[index] += np.einsum("ij,ij->i", rows, rows) / rows.shape[1]
        step = RATE * rows / np.sqrt(squares[index])[:, None]
        p[index] += step if p.ndim > 1 else step[:, 0]


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equals begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _context(tokens: np.ndarray, begins: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token, and the one before that; the end where the document hasn't begun."""
    one, two = np.full(len(tokens), end, np.int64), np.full(len(tokens), end, np.int64)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    one[begins] = end
    two[begins] = end
    two[np.minimum(begins + 1, len(tokens) - 1)] = end
    return one, two


class Counts:
    """What tasks know of the training corpus: the dictionary, and sums of the rare units."""

    def __init__(self, top: list[tuple[bytes, int]], units: Units, n: int, v: int, ends: int, rare_n: np.ndarray, rare_v: np.ndarray):
        self.units, self.known = units, dict(top)
        self.head = {w: k for k, (w, _) in enumerate(top[: units.head])}
        self.n, self.v, self.ends = n, v, ends
        self.unit_n = np.concatenate([[c for _, c in top[: units.head]], rare_n, [ends]]).astype(np.float64)
        self.rare_log = np.log10(rare_n + 0.5 * (rare_v + 1))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over the documents, added up inside batches first."""

    def count(b: pa.RecordBatch) -> dict:
        words = Words(b.column("text"), lower=True)
        return {"word": pa.array(words.vocab, pa.binary()), "n": pa.array(np.bincount(words.codes, minlength=len(words.vocab)).astype(np.int64), pa.int64())}

    bound_arrow(docs.sparkSession)
    return map_arrow(only(docs, "text"), count, "word binary, n bigint", "text").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(table: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """All words from a count on, most frequent first; the bound comes from a histogram of counts, so that no more than `most` rows leave their tasks."""
    level = F.floor(F.log2("n") * 16)
    held, least = 0, None
    for r in sorted(table.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        if held + r["count"] > most:
            break
        held, least = held + r["count"], r.level
    if least is None:
        return []
    rows = [(bytes(r.word), r.n) for r in table.where(level >= least).collect()]
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def corpus_counts(docs: DataFrame) -> tuple[Counts, DataFrame]:
    """Counts for the tasks, and the table of all words."""
    table = materialize(word_counts(docs), "word-counts")
    n_docs = docs.count()
    words, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = frequent(table, DICTIONARY)
    units = Units(min(len(top), int(GROWTH * (words + n_docs) ** (1 / 3))))
    sums = table.groupBy(F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(units.rare)).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    rare_n, rare_v = np.zeros(units.rare), np.zeros(units.rare)
    for r in sums:
        rare_n[r.k], rare_v[r.k] = r.n, r.v
    for w, c in top[: units.head]:
        rare_n[units.rare_unit(w) - units.head] -= c
        rare_v[units.rare_unit(w) - units.head] -= 1
    return Counts(top, units, words + n_docs, distinct + (n_docs > 0), n_docs, rare_n, rare_v), table


ENCODED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, known_log double, head_log double, rare_share double, units binary, tail array<struct<h: bigint, n: int>>"


def encode(docs: DataFrame, counts: Counts) -> DataFrame:
    """Per document: unit numbers (32-bit), what the dictionary says of its words, and hashes of the words beyond it."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(b: pa.RecordBatch) -> dict:
        c = shared.value
        words = Words(b.column("text"), lower=True)
        vocab, codes, offsets = words.vocab, words.codes, words.offsets
        n = np.fromiter((c.known.get(w, 0) for w in vocab), np.int64, len(vocab))
        head = np.fromiter((c.head.get(w, -1) for w in vocab), np.int64, len(vocab))
        kind = np.fromiter((h if h >= 0 else c.units.rare_unit(w) for w, h in zip(vocab, head.tolist(), strict=True)), np.int64, len(vocab))
        log = np.where(n > 0, np.log10(n + 0.5), 0.0)
        doc = np.repeat(np.arange(b.num_rows), words.counts)
        of = lambda x: np.bincount(doc, x, b.num_rows)
        share = np.where(head >= 0, 0.0, c.rare_log[np.maximum(kind - c.units.head, 0) % c.units.rare])
        at = np.concatenate([[0], np.cumsum(words.counts + 1)])
        data = np.insert(kind[codes], offsets[1:], c.units.end).astype("<i4").tobytes()
        blobs = [data[4 * a : 4 * e] for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        # words beyond the dictionary: (document, word) pairs with counts
        far = np.flatnonzero(n[codes] == 0)
        width = max(len(vocab), 1)
        pair, many = np.unique(doc[far] * width + codes[far], return_counts=True)
        d, k = np.divmod(pair, width)
        used, back = np.unique(k, return_inverse=True)
        hashes = np.fromiter((xxhash.xxh64_intdigest(vocab[i], 42) for i in used.tolist()), np.uint64, len(used))[back] if len(k) else np.zeros(0, np.uint64)
        lists = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=b.num_rows))]).astype(np.int32)
        tail = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(signed(hashes)), pa.array(many.astype(np.int32))], ["h", "n"]))
        return {
            "doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "n_tokens": pa.array(words.counts + 1), "n_known": pa.array((of((n > 0)[codes]) + (c.ends > 0)).astype(np.int64)),
            "known_log": pa.array(of(log[codes])), "head_log": pa.array(of(np.where(head >= 0, log, 0.0)[codes])), "rare_share": pa.array(of(share[codes])), "units": pa.array(blobs, pa.binary()), "tail": tail,
        }

    return map_arrow(docs, run, ENCODED, "text")


def _sequences(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    blobs = b.column("units").to_pylist()
    n = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    return np.frombuffer(b"".join(blobs), dtype="<i4").astype(np.int64), np.cumsum(n) - n


def train(encoded: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    """Adds the tasks' averaged changes after each round; round k sees slice k of the training documents."""
    spark = encoded.sparkSession
    model, noise = Model(counts.units, counts.unit_n), Noise(counts.units, counts.unit_n)
    rows = encoded.where("NOT held_out").select("units", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(rounds)).alias("slice"))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((model, noise))

        def learn(batches, shared=shared, k=k):
            start, noise = shared.value
            before = start.pack()
            own = Learner(start.unpacked(before), noise, 100_003 * TaskContext.get().partitionId() + k)
            seen = 0
            for b in batches_of(batches, "units", 4 << 20):
                tokens, begins = _sequences(b)
                own.learn(tokens, begins)
                seen += len(tokens)
            if seen:
                parts = np.array_split((own.model.pack() - before).astype(np.float16), SLICES)
                yield pa.RecordBatch.from_pydict({"part": pa.array(range(SLICES), pa.int32()), "change": pa.array([x.tobytes() for x in parts], pa.binary()), "n": pa.array([seen] * SLICES, pa.int64())})

        changed = rows.where(F.col("slice") == k).select("units").mapInArrow(learn, "part int, change binary, n bigint")
        found = changed.repartition(SLICES, "part").mapInArrow(_average, "part int, change binary").collect()  # one model
        if found:
            model = model.unpacked(model.pack() + np.concatenate([np.frombuffer(r.change, np.float32) for r in sorted(found)]))
        shared.unpersist()
    return model


def _average(batches):
    sums: dict[int, np.ndarray] = {}
    seen: dict[int, int] = {}
    for b in batches:
        for part, change, n in zip(b.column("part").to_pylist(), b.column("change").to_pylist(), b.column("n").to_pylist(), strict=True):
            x = np.frombuffer(change, np.float16).astype(np.float64) * n
            sums[part] = sums[part] + x if part in sums else x
            seen[part] = seen.get(part, 0) + n
    if sums:
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "change": pa.array([(sums[p] / seen[p]).astype(np.float32).tobytes() for p in sums], pa.binary())})


def unit_scores(encoded: DataFrame, model: Model) -> DataFrame:
    """Adds `unit_log`, the log10 probability of the document's units."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kept = ("row", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "head_log", "rare_share")

    def run(b: pa.RecordBatch) -> dict:
        m = shared.value
        tokens, begins = _sequences(b)
        one, two = _context(tokens, begins, m.units.end)
        log = np.empty(len(tokens))
        for lo in range(0, len(tokens), 1 << 15):
            s = slice(lo, lo + (1 << 15))
            log[s] = m.log_p(tokens[s], one[s], two[s])
        total = np.add.reduceat(log, begins) / np.log(10) if len(begins) else np.zeros(0)
        return {n: b.column(n) for n in kept} | {"unit_log": pa.array(total)}

    return map_arrow(encoded.drop("tail"), run, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, known_log double, head_log double, rare_share double, unit_log double", "units", 4 << 20)


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from the documents where held_out isn't true."""
    bound_arrow(docs.sparkSession)
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts, table = corpus_counts(rows.where("NOT held_out"))
    encoded = materialize(encode(rows, counts).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = train(encoded, counts)
    tails = encoded.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.n")
    by_hash = table.groupBy(F.xxhash64("word").alias("h")).agg(F.sum("n").alias("c"))
    c = F.coalesce("c", F.lit(0))
    found = tails.join(by_hash, "h", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("tail_log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    out = unit_scores(encoded, model).join(found, "row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    words_log = F.col("known_log") + tail_log
    base = words_log + F.lit(float(np.log10(counts.ends + 0.5))) - F.col("n_tokens") * float(np.log10(counts.n + 0.5 * (counts.v + 1)))
    own = F.col("unit_log") + words_log - F.col("head_log") - F.col("rare_share")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(counts.n).cast("long").alias("train_tokens"), base.alias("base_score"), (own if counts.n else base).alias("score"))
