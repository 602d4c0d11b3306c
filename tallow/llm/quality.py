"""Quality by co-training: a text view and a metadata view that teach each other, then are calibrated and combined.

The text view sees hashed letter trigrams and words, shares of kinds of characters and repetition of words, all relative, so that it doesn't see the length; the metadata
view sees language, source and length. Both are logistic models, fitted by Newton steps whose sums Spark adds up over all documents, labelled or not. In each round a
view's confident decisions on documents without a label become labels, of less weight, for the other. One in CALIBRATION of the labelled documents is held back
from that; on those each view's log-odds are calibrated, and a logistic model on both combines them. Every document is scored.

Nulls: null or empty texts have zero text features; null languages and sources are a value of their own. Labels that are null are ignored. Without labels
of both kinds all scores are 0.5. A document with several labels counts each time in training and is scored once a row. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, bound_arrow, map_arrow, materialize, only

ROUNDS = 3
STEPS = 4
CONFIDENT = 0.95
#: Weight of a pseudo-label against a true one.
PSEUDO = 0.2
RIDGE = 1e-3
BINS = 32
#: Buckets of hashed trigrams, and as many of hashed words.
HASHED = 96
#: One in so many labelled documents is held back for calibration.
CALIBRATION = 4

_GROUPS = np.zeros((8, 256))
for _k, _of in enumerate((range(65, 91), range(97, 123), range(48, 58), range(128, 256), b" \t\r", b"\n", b".,;:!?'\"-", b"#*%$&@|<>{}[]=_~^\\/+")):
    _GROUPS[_k, list(_of)] = 1


def _hashed(bucket: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Square roots of each document's shares of the buckets."""
    counts = np.bincount(doc * HASHED + bucket, minlength=n * HASHED).reshape(n, HASHED).astype(np.float64)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def text_features(column: pa.Array) -> np.ndarray:
    texts = as_bytes(column.fill_null(""))
    n_docs = len(texts)
    words = Words(column)
    sizes = np.fromiter(map(len, texts), np.int64, n_docs)
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(n_docs), sizes)
    bytes_ = np.bincount(owner * 256 + data, minlength=n_docs * 256).reshape(n_docs, 256) if n_docs else np.zeros((0, 256))
    shares = bytes_ @ _GROUPS.T / np.maximum(sizes, 1)[:, None]
    low = data | np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    tri = low[:-2].astype(np.uint32) << 16 | low[1:-1].astype(np.uint32) << 8 | low[2:]
    whole = owner[:-2] == owner[2:]
    trigrams = _hashed(((tri[whole] * np.uint32(2654435761)) >> np.uint32(8)).astype(np.int64) % HASHED, owner[:-2][whole], n_docs)
    n = np.maximum(words.counts, 1)
    doc = np.repeat(np.arange(n_docs), words.counts)
    hashed = _hashed(words.mapped(lambda w: zlib.crc32(w.lower()) % HASHED, np.int64), doc, n_docs)
    letters = words.mapped(len, np.float64)
    mean = np.bincount(doc, letters, n_docs) / n
    long_ = np.bincount(doc, letters > 20, n_docs) / n
    pair, many = np.unique(doc * max(len(words.vocab), 1) + words.codes, return_counts=True)
    own = pair // max(len(words.vocab), 1)
    distinct = np.bincount(own, minlength=n_docs) / n
    top = np.zeros(n_docs)
    np.maximum.at(top, own, many)
    return np.column_stack([np.ones(n_docs), shares, np.sqrt(shares), mean / 10, long_, distinct, top / n, trigrams, hashed])


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    x = np.zeros((len(lang), 2 + 2 * BINS))
    x[:, 0] = 1
    x[:, 1] = np.log1p(np.maximum(np.array([c or 0 for c in n_chars], dtype=np.float64), 0)) / 10
    for base, values in ((2, lang), (2 + BINS, source)):
        for k, v in enumerate(values):
            x[k, base + zlib.crc32(str(v).encode()) % BINS] = 1
    return x


def features(docs: DataFrame) -> DataFrame:
    bound_arrow(docs.sparkSession)

    def run(b: pa.RecordBatch) -> dict:
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.astype(np.float32).ravel()))
        return {"doc_id": b.column("doc_id"), "x": lists(text_features(b.column("text"))), "m": lists(meta_features(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars"))))}

    rows = only(docs, "doc_id", "text", "lang", "source", "n_chars").withColumns({"doc_id": F.col("doc_id").cast("long"), "n_chars": F.col("n_chars").cast("double"), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")})
    return map_arrow(rows, run, "doc_id bigint, x array<float>, m array<float>", "text")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _p(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def _sums(rows: DataFrame, part) -> list[np.ndarray]:
    """Adds up the arrays that part(batch) gives, over all rows: first inside tasks, then on the driver (some 40 KB a task)."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                got = part(b)
                total = got if total is None else [a + g for a, g in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(total)), pa.int32()), "v": pa.array([t.ravel().tolist() for t in total], pa.list_(pa.float64()))})

    found = rows.mapInArrow(run, "k int, v array<double>").select("k", F.posexplode("v").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    out: dict[int, dict[int, float]] = {}
    for r in found.collect():
        out.setdefault(r.k, {})[r.i] = r.v
    return [np.array([out[k][i] for i in range(len(out[k]))]) for k in sorted(out)]


def _newton(beta: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float, prior: np.ndarray | float = 0.0) -> np.ndarray:
    """A Newton step of a logistic model that a ridge draws to the prior."""
    d = len(beta)
    step = np.linalg.solve(h.reshape(d, d) + ridge * np.eye(d), g - ridge * (beta - prior))
    return beta + np.clip(step, -4, 4)


def co_train(rows: DataFrame, dims: tuple[int, int], rounds: int = ROUNDS, steps: int = STEPS) -> list[np.ndarray]:
    """Weights of the text view, of the metadata view, of each one's calibration, and of their combination. rows: x, m, y (null without a label), held (out of
    the views' training)."""
    spark = rows.sparkSession
    betas = [np.zeros(dims[0]), np.zeros(dims[1])]
    teachers = None
    for _ in range(rounds):
        for _ in range(steps):
            shared = spark.sparkContext.broadcast((betas, teachers))

            def part(b, shared=shared):
                now, teach = shared.value
                views = [_matrix(b.column("x")), _matrix(b.column("m"))]
                y = b.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
                free = np.isnan(y)
                known = ~free & ~b.column("held").to_numpy(zero_copy_only=False)
                out = []
                for k in (0, 1):
                    label, w = np.where(known, y, 0.0), known.astype(np.float64)
                    if teach is not None:
                        q = _p(views[1 - k], teach[1 - k])
                        sure = free & ((q >= CONFIDENT) | (q <= 1 - CONFIDENT))
                        label, w = np.where(sure, q >= 0.5, label), np.where(sure, PSEUDO, w)
                    p = _p(views[k], now[k])
                    out += [views[k].T @ (w * (label - p)), (views[k] * (w * p * (1 - p))[:, None]).T @ views[k], np.array([w.sum()])]
                return out

            s = _sums(rows, part)
            betas = [_newton(betas[k], s[3 * k], s[3 * k + 1], RIDGE * max(s[3 * k + 2][0], 1)) for k in (0, 1)]
        teachers = [b.copy() for b in betas]
    # three small models on the log-odds of documents that the views haven't learnt from
    priors = [np.array([0.0, 1.0]), np.array([0.0, 1.0]), np.array([0.0, 0.5, 0.5])]
    last = priors
    held = rows.where("y IS NOT NULL AND held")
    for _ in range(2 * steps):
        shared = spark.sparkContext.broadcast((betas, last))

        def part(b, shared=shared):
            (tx, mt), models = shared.value
            one, text, meta = np.ones(b.num_rows), _matrix(b.column("x")) @ tx, _matrix(b.column("m")) @ mt
            y = b.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            out = []
            for z, c in zip((np.column_stack([one, text]), np.column_stack([one, meta]), np.column_stack([one, text, meta])), models, strict=True):
                p = _p(z, c)
                out += [z.T @ (y - p), (z * (p * (1 - p))[:, None]).T @ z]
            return out

        if not (s := _sums(held, part)):
            break
        last = [_newton(c, s[2 * k], s[2 * k + 1], 1.0, prior) for k, (c, prior) in enumerate(zip(last, priors, strict=True))]
    return [*betas, *last]


def score_quality(docs: DataFrame, labels: DataFrame, training: Column | None = None, label: str = "quality") -> DataFrame:
    """doc_id, text_score, meta_score, score (0 to 1) of every document; learns from labels where `training` holds (on doc_id)."""
    table = materialize(features(docs), "quality-features")
    known = only(labels, "doc_id", label).where(F.col(label).isNotNull())
    if training is not None:
        known = known.where(training)
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    kinds = known.agg(F.min("y"), F.max("y")).first()
    if kinds[0] is None or kinds[0] == kinds[1]:
        half = F.lit(0.5)
        return table.select("doc_id", half.alias("text_score"), half.alias("meta_score"), half.alias("score"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) == 0
    rows = materialize(table.join(known, "doc_id", "left").select("x", "m", "y", F.coalesce(held, F.lit(False)).alias("held")), "quality-rows")
    dims = rows.select(F.size("x"), F.size("m")).first() or (1, 1)
    weights = co_train(rows, (dims[0], dims[1]))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        tx, mt, text, meta, both = shared.value
        for b in batches:
            if b.num_rows:
                x, m = _matrix(b.column("x")), _matrix(b.column("m"))
                z = np.column_stack([np.ones(b.num_rows), x @ tx, m @ mt])
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_score": pa.array(_p(z[:, :2], text)), "meta_score": pa.array(_p(z[:, [0, 2]], meta)), "score": pa.array(_p(z, both))})

    return table.mapInArrow(run, "doc_id bigint, text_score double, meta_score double, score double")
