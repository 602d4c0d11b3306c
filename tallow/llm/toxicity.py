"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words sums, over all sequences of four letters, the products of their gap-weighted counts: letters may stand apart, up to
MAX_GAP letters in all, and each letter between them costs a factor DECAY. So an insult keeps most of its
weight when letters are inserted, and signs inserted between its letters don't count at all. Letters that stand alone, LETTERS or more in a row,
also make a word together. A sentence's score is that of its most suspicious word, a text's that of its most suspicious sentence, so length doesn't
dilute a finding.

Training takes the sentences of at most about LABELLED labelled documents, chosen by a hash of the doc_id, each sentence once. That bound is also what makes the
labels fit for a broadcast, so no text is shuffled to find its label. Spark counts, for each word and each unbroken sequence of four letters, the toxic and clean sentences
that hold it. Words of toxic sentences with a sequence that is far more frequent there than chance allows are suspects:
a sentence's label says that some word is toxic, not which. Suspects and others, in samples of documented sizes, train the machine: landmarks from both, the
kernel against landmarks whitened (Nyström), a squared-hinge linear machine on that by Newton's method. Then the clean words that score highest
are added and it is trained again. As the machine is linear in the landmarks' kernel values, and these are inner products over letter
sequences, its score collapses to one weight a sequence, in a table of 2**20 floats. A logistic curve, fitted on one in CALIBRATION of the
labelled documents that the machine doesn't train on, turns the highest word score into a probability.

Nulls: a null or empty text has the score of a text without suspects. Labels that are null are ignored; several labels of a
document count once for each kind. Without labelled rows of both kinds the score is the share of toxic rows seen, 0 without any. Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, bound_arrow, map_arrow, materialize, only, scratch

LETTERS = 4
MAX_GAP = 3
DECAY = 0.6
LANDMARKS = 384
#: Labelled documents that training takes, about; the bound of its sample.
LABELLED = 100_000
#: One in so many labelled documents is kept for the logistic curve.
CALIBRATION = 4
#: Words that train the machine: the sample's bounds, and the files that hold the words' counts.
SUSPECTS = 6_000
OTHERS = 16_000
HARD = 4_000
FILES = 16
PENALTY = 1e-4
#: A letter sequence is suspicious from this log-likelihood ratio on, which chance hardly reaches among a million sequences.
LEAST_GAIN = 10.0
ROUNDS = 3
THRESHOLD = 0.3

_EDGE = 27
#: Letters, with digits and signs that stand for letters; edges of words; the rest of UTF-8 in four classes. Other signs are skipped.
_LOOKALIKE = dict(zip(b"013457@$!", b"oieastasi", strict=True))


def _symbols() -> tuple[bytes, bytes]:
    table = bytearray(256)
    for b in range(256):
        c = _LOOKALIKE.get(b, b)
        if 65 <= c <= 90 or 97 <= c <= 122:
            table[b] = (c | 32) - 96
        elif 0x80 <= b < 0xC0:
            table[b] = 28 + (b & 3)
        elif b in b"\t ":
            table[b] = _EDGE
    return bytes(table), bytes(b for b in range(256) if not table[b])


TABLE, SKIPPED = _symbols()
#: Places of the later letters after the first, with all gaps up to MAX_GAP.
PATTERNS = [p for p in itertools.combinations(range(1, LETTERS + MAX_GAP), LETTERS - 1)]


def _laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words, each between edges; the word of each symbol; where each word begins."""
    joined = b" " + b"\t ".join(words) + b"\t"
    marks = np.frombuffer(joined.translate(None, SKIPPED), dtype=np.uint8)
    starts = np.flatnonzero(marks == 32)
    symbols = np.frombuffer(TABLE, dtype=np.uint8)[marks].astype(np.int32)
    word = np.cumsum(marks == 32) - 1
    return symbols, word.astype(np.int32), starts


def _sequences(symbols: np.ndarray, word: np.ndarray):
    """(code, weight, validity) of the letter sequences that begin at each symbol, pattern by pattern."""
    for p in PATTERNS:
        n = len(symbols) - p[-1]
        if n <= 0:
            continue
        code = symbols[:n] << 5 | symbols[p[0] : p[0] + n]
        for k in p[1:]:
            code = code << 5 | symbols[k : k + n]
        yield code, np.float32(DECAY ** (p[-1] - LETTERS + 1)), word[:n] == word[p[-1] :]


def word_scores(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Inner product of each word's normed sequence counts with the weights; 0 for words of too few letters."""
    if not words:
        return np.zeros(0, dtype=np.float32)
    symbols, word, starts = _laid_out(words)
    total, norm = np.zeros(len(symbols), dtype=np.float32), np.zeros(len(symbols), dtype=np.float32)
    for code, w, ok in _sequences(symbols, word):
        n = len(code)
        total[:n] += weights[code] * (w * ok)
        norm[:n] += w * w * ok
    total, norm = np.add.reduceat(total, starts), np.add.reduceat(norm, starts)
    return total / np.sqrt(np.maximum(norm, 1e-9)) * (norm > 0)


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (word, code, value), normed."""
    symbols, word, starts = _laid_out(words)
    parts = [(word[: len(c)][ok], c[ok], np.full(int(ok.sum()), w)) for c, w, ok in _sequences(symbols, word)]
    row, code, value = (np.concatenate([p[k] for p in parts]) for k in range(3))
    norm = np.sqrt(np.maximum(np.bincount(row, value.astype(np.float64) ** 2, len(words)), 1e-9))
    return row, code, value / norm[row]


class StringKernelMachine:
    """Fits on words with labels 1 and -1 and example weights; `weights` then holds one number a letter sequence, `bias` the rest."""

    def fit(self, words: list[bytes], y: np.ndarray, importance: np.ndarray, landmarks: int = LANDMARKS, penalty: float = PENALTY, seed: int = 7) -> StringKernelMachine:
        rng = np.random.default_rng(seed)
        pos, neg = np.flatnonzero(y > 0), np.flatnonzero(y < 0)
        half = landmarks // 2
        take = lambda of, n: of if len(of) <= n else rng.choice(of, n, replace=False, p=importance[of] / importance[of].sum())
        chosen = np.concatenate([take(pos, half), take(neg, landmarks - half)])
        row, code, value = _features([words[k] for k in chosen])
        known, column = np.unique(code, return_inverse=True)
        dense = np.zeros((len(known), len(chosen)), dtype=np.float32)
        np.add.at(dense, (column, row), value)
        gram = (dense.T @ dense).astype(np.float64)
        values, vectors = np.linalg.eigh(gram)
        good = values > 1e-6 * values[-1]
        whiten = vectors[:, good] / np.sqrt(values[good])
        x = np.empty((len(words), int(good.sum()) + 1), dtype=np.float32)
        for lo in range(0, len(words), 500):
            part = words[lo : lo + 500]
            r, c, v = _features(part)
            at = np.searchsorted(known, c)
            hit = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == c)
            r, at, v = r[hit], at[hit], v[hit]
            k = np.zeros((len(part), len(chosen)), dtype=np.float32)
            order = np.argsort(r, kind="stable")
            r, at, v = r[order], at[order], v[order]
            cuts = np.searchsorted(r, np.arange(len(part) + 1))
            for i in range(len(part)):
                a, e = cuts[i], cuts[i + 1]
                if e > a:
                    k[i] = v[a:e].astype(np.float32) @ dense[at[a:e]]
            x[lo : lo + len(part), :-1] = k @ whiten
        x[:, -1] = 1.0
        beta = self._squared_hinge(x, y, importance, penalty)
        alpha = whiten @ beta[:-1]
        self.weights = np.zeros(32**LETTERS, dtype=np.float32)
        self.weights[known] = dense @ alpha.astype(np.float32)
        self.bias = float(beta[-1])
        return self

    @staticmethod
    def _squared_hinge(x, y, importance, penalty, steps: int = 15) -> np.ndarray:
        w = importance / importance.sum()
        beta = np.zeros(x.shape[1])
        ridge = np.full(x.shape[1], penalty)
        ridge[-1] = 1e-9
        for _ in range(steps):
            on = np.flatnonzero(y * (x @ beta) < 1)
            hessian, slope = np.diag(ridge), -ridge * beta
            for lo in range(0, len(on), 2000):  # blocks, to hold little
                at = on[lo : lo + 2000]
                xs = x[at].astype(np.float64)
                hessian += (xs * w[at, None]).T @ xs
                slope += xs.T @ (w[at] * (y[at] - xs @ beta))
            step = np.linalg.solve(hessian, slope)
            beta = beta + step
            if np.abs(step).max() < 1e-6:
                break
        return beta

    def scores(self, words: list[bytes]) -> np.ndarray:
        return word_scores(words, self.weights) + self.bias


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", training: Column | None = None, most: int = LABELLED) -> DataFrame:
    """doc_id, text, label (0 or 1) of about `most` labelled documents at most, or of all if there are no more; each kind of label once a doc_id."""
    kinds = only(labels, "doc_id", label).where(F.col(label).isNotNull())
    if training is not None:
        kinds = kinds.where(training)
    kinds = materialize(kinds.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("label")).distinct(), "toxicity-labels")
    n = kinds.count()
    if n > most:
        kinds = kinds.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int((1 << 32) * most / n))
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.join(F.broadcast(kinds), "doc_id").select("doc_id", "text", "label")  # `most` rows of 12 bytes


def labelled_sentences(known: DataFrame) -> DataFrame:
    """sentence, label: the sentences of labelled documents, each with its document's label."""
    return known.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+")).alias("sentence"), "label")


def spelled_out(words: Words) -> tuple[list[bytes], np.ndarray]:
    """Words made of LETTERS or more one-letter words in a row, and the text that each is of."""
    lone = np.fromiter((len(w) == 1 for w in words.vocab), bool, len(words.vocab))[words.codes] if words.vocab else np.zeros(0, bool)
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    at = np.flatnonzero(lone)
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(doc[at]) > 0)])) if len(at) else at
    sizes = np.diff(np.append(cuts, len(at)))
    runs = [(int(at[c]), int(n)) for c, n in zip(cuts[sizes >= LETTERS], sizes[sizes >= LETTERS], strict=True)]
    return [b"".join([words.vocab[c] for c in words.codes[a : a + n].tolist()]) for a, n in runs], doc[[a for a, _ in runs]] if runs else doc[:0]


def word_statistics(sentences: DataFrame) -> DataFrame:
    """word, n1, n0: how many toxic and clean sentences hold the word; counted inside tasks before the shuffle."""

    def count(b: pa.RecordBatch) -> dict:
        words = Words(b.column("sentence"), lower=True)
        y = b.column("label").to_numpy().astype(bool)
        sentence = np.repeat(np.arange(b.num_rows), words.counts)
        pair = np.unique(sentence * max(len(words.vocab), 1) + words.codes)
        s, c = np.divmod(pair, max(len(words.vocab), 1))
        n1 = np.bincount(c, y[s], len(words.vocab)).astype(np.int64)
        n0 = np.bincount(c, ~y[s], len(words.vocab)).astype(np.int64)
        more, of = spelled_out(words)
        n1, n0 = (np.concatenate([n, at]) for n, at in ((n1, y[of].astype(np.int64)), (n0, (~y[of]).astype(np.int64))))
        return {"word": pa.array([*words.vocab, *more], pa.binary()), "n1": pa.array(n1), "n0": pa.array(n0)}

    bound_arrow(sentences.sparkSession)
    return map_arrow(sentences, count, "word binary, n1 bigint, n0 bigint", "sentence").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def sequence_gains(stats: DataFrame, rate: float, least: float = LEAST_GAIN) -> np.ndarray:
    """For each unbroken letter sequence, the log-likelihood ratio of its own share of toxic sentences against the usual one; 0 below `least`."""

    def count(batches):
        for b in batches:
            words = b.column("word").to_pylist()
            if not words:
                continue
            symbols, word, _ = _laid_out(words)
            code, _, ok = next(_sequences(symbols, word), (np.zeros(0, np.int32), 0, np.zeros(0, bool)))
            pair = np.unique(word[: len(code)][ok].astype(np.int64) << 20 | code[ok])
            w, c = pair >> 20, pair & (1 << 20) - 1
            known, at = np.unique(c, return_inverse=True)
            n1 = np.bincount(at, b.column("n1").to_numpy()[w], len(known))
            n0 = np.bincount(at, b.column("n0").to_numpy()[w], len(known))
            yield pa.RecordBatch.from_pydict({"code": pa.array(known), "n1": pa.array(n1), "n0": pa.array(n0)})

    codes = stats.mapInArrow(count, "code bigint, n1 double, n0 double").groupBy("code").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    n, share = F.col("n1") + F.col("n0"), (F.col("n1") + 0.5 * rate) / (F.col("n1") + F.col("n0") + 0.5)
    gain = F.col("n1") * F.log(share / rate) + F.col("n0") * F.log((1 - share) / (1 - rate))
    found = codes.where((n > 0) & (share > rate) & (F.col("n0") * 4 <= F.col("n1"))).withColumn("gain", gain).where(F.col("gain") >= least)
    out = np.zeros(32**LETTERS, dtype=np.float32)
    for r in found.collect():  # 2**20 sequences at most
        out[r.code] = r.gain
    return out


def _suspicion(b: pa.RecordBatch, gains: np.ndarray) -> pa.RecordBatch:
    """Adds each word's largest gain among its unbroken sequences."""
    words = b.column("word").to_pylist()
    best = np.zeros(len(words), dtype=np.float64)
    if words:
        symbols, word, _ = _laid_out(words)
        for code, _, ok in itertools.islice(_sequences(symbols, word), 1):
            np.maximum.at(best, word[: len(code)][ok], gains[code[ok]])
    return pa.RecordBatch.from_pydict({n: b.column(n) for n in ("word", "n1", "n0")} | {"gain": pa.array(best)})


def train(sentences: DataFrame, suspects: int = SUSPECTS, others: int = OTHERS, hard: int = HARD, rounds: int = ROUNDS) -> StringKernelMachine | None:
    """A machine from labelled sentences; None if one of the labels is missing. The driver holds suspects + others + rounds * hard words, and
    while it looks for the highest, FILES times as many rows of a word and its counts."""
    # copies of a document would make each of its words a suspect, so a sentence counts once
    once = sentences.groupBy("sentence").agg(F.min("label").alias("label"))
    stats = materialize(word_statistics(once).coalesce(FILES), "word-statistics")
    total = stats.agg(F.sum("n1"), F.sum("n0")).first()
    if not total[0] or not total[1]:
        return None
    gains = stats.sparkSession.sparkContext.broadcast(sequence_gains(stats, total[0] / (total[0] + total[1])))
    rated = stats.mapInArrow(lambda it: (_suspicion(b, gains.value) for b in it), "word binary, n1 bigint, n0 bigint, gain double")
    rated = materialize(rated, "word-suspicion")
    suspected = rated.where((F.col("gain") > 0) & (F.col("n1") > 0) & (F.col("n0") * 20 <= F.col("n1")))
    top = suspected.orderBy(F.desc("n1"), "word").limit(suspects // 2).collect() + suspected.orderBy(F.xxhash64("word"), "word").limit(suspects // 2).collect()
    if not top:
        return None
    clean = rated.where(F.col("n0") > 0)
    common_ = clean.orderBy(F.desc("n0"), "word").limit(others // 4).collect()
    spread = clean.orderBy(F.xxhash64("word"), "word").limit(others - others // 4).collect()
    pos = {bytes(r.word): float(r.n1) for r in top}
    neg = {bytes(r.word): float(r.n0) for r in [*common_, *spread] if bytes(r.word) not in pos}
    machine, confused = None, {}
    for k in range(rounds):
        words = [*pos, *neg, *confused]
        y = np.array([1.0] * len(pos) + [-1.0] * (len(neg) + len(confused)))
        shares = [np.sqrt(np.array(list(v.values()))) for v in (pos, neg, confused) if v]
        w = np.concatenate([v / v.sum() for v in shares])
        machine = StringKernelMachine().fit(words, y, w)
        if k + 1 == rounds:
            break
        held = stats.sparkSession.sparkContext.broadcast((machine.weights, machine.bias))
        ranked = clean.select("word", "n0", "n1").mapInArrow(lambda it, held=held: (pa.RecordBatch.from_pydict({"word": b.column("word"), "n0": b.column("n0"), "n1": b.column("n1"), "s": pa.array(word_scores(b.column("word").to_pylist(), held.value[0]).astype(np.float64))}) for b in it), "word binary, n0 bigint, n1 bigint, s double")
        for r in ranked.where("n0 > n1").orderBy(F.desc("s"), "word").limit(hard).collect():
            if r.s + machine.bias > -1:  # inside the margin, or beyond
                confused[bytes(r.word)] = float(r.n0)
                neg.pop(bytes(r.word), None)
                pos.pop(bytes(r.word), None)
    return machine


def _highest(words: Words, scores: np.ndarray) -> np.ndarray:
    out = np.full(len(words.counts), -np.inf)
    some = words.counts > 0
    if some.any():
        out[some] = np.maximum.reduceat(scores[words.codes], words.offsets[:-1][some])
    return out


def highest_scores(docs: DataFrame, machine: StringKernelMachine, *keep: str) -> DataFrame:
    """The columns `keep` and `margin`, the highest word score of the text; the bias for a text without words."""
    held = docs.sparkSession.sparkContext.broadcast((machine.weights, machine.bias))

    def run(b: pa.RecordBatch) -> dict:
        weights, bias = held.value
        words = Words(b.column("text"), lower=True)
        top = np.maximum(_highest(words, word_scores(words.vocab, weights)), 0)
        more, of = spelled_out(words)
        np.maximum.at(top, of, word_scores(more, weights))
        top += bias
        return {n: b.column(n) for n in keep} | {"margin": pa.array(top.astype(np.float64))}

    bound_arrow(docs.sparkSession)
    types = dict(docs.dtypes)
    return map_arrow(docs, run, ", ".join(f"`{n}` {types[n]}" for n in keep) + ", margin double", "text", 4 << 20)


def calibrate(margins: DataFrame, label: str = "label") -> tuple[float, float]:
    """Logistic slope and offset from a histogram of margins (4,000 bins of a hundredth) by label."""
    bins = margins.groupBy(F.round(F.greatest(F.least("margin", F.lit(20.0)), F.lit(-20.0)), 2).alias("m"), F.col(label).alias("y")).count().collect()
    m = np.array([r.m for r in bins])
    y = np.array([float(r.y) for r in bins])
    n = np.array([float(r["count"]) for r in bins])
    x = np.stack([m, np.ones(len(m))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(h, x.T @ (n * (y - p)) - np.array([1e-2, 1e-3]) * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fitted(docs: DataFrame, labels: DataFrame, training: Column | None, label: str) -> tuple[StringKernelMachine | None, float, float, float]:
    """The machine (None if a kind of label is missing), the share of toxic labelled documents, and the logistic curve's slope and offset."""
    with scratch(docs.sparkSession):
        known = materialize(labelled_documents(docs, labels, label, training), "toxicity-known")
        own = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION)) == 0
        machine = train(labelled_sentences(known.where(~own)))
        share = float(known.agg(F.avg("label")).first()[0] or 0.0)
        return machine, share, *(calibrate(highest_scores(known.where(own), machine, "label")) if machine else (0.0, 0.0))


def score_toxicity(docs: DataFrame, labels: DataFrame, training: Column | None = None, label: str = "toxic", columns: list[str] | None = None) -> DataFrame:
    """The columns asked for (doc_id) and `score`, 0 to 1, of every document; learns from labelled rows where `training` holds."""
    columns = columns or ["doc_id"]
    bound_arrow(docs.sparkSession)
    machine, share, a, b = fitted(docs, labels, training, label)
    if machine is None:
        return docs.select(*[F.col(f"`{c}`") for c in columns], F.lit(share).alias("score"))
    need = dict.fromkeys([*columns, "text"])
    out = highest_scores(only(docs, *need), machine, *columns)
    logit = F.greatest(F.least(F.col("margin") * a + b, F.lit(30.0)), F.lit(-30.0))
    return out.withColumn("score", 1 / (1 + F.exp(-logit))).drop("margin")
