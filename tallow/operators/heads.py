"""A trained head over stored vectors: gated attention over a series' slices, a vector for its plane, gated attention over the series, one output a column.

The data stay where they are. A training step is a Spark job: tasks work out the gradient of the masked, weighted loss for their studies, for the models of all folds in one pass, and the
gradients are added up in pieces, by fold and piece, on the way to the driver, which holds the models and the optimizer's state (bounded by the model, not by the data). Studies lie
in `batches` groups by hash, written apart, so an epoch reads them once; epochs take the groups in a drawn order. What is random (dropped slices, noise, dropout) is drawn by seed, epoch and study, so the
sum doesn't depend on how rows are dealt out.

A study is one row of at most slots x slices vectors. Cells without a label or weight count for nothing; slices that aren't there get no attention, a series mask takes whole series out, and a
study without any is pooled evenly. A fold's model leaves the fold's studies out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder, remove

#: Codes of planes; the first stands for all others.
PLANES = ("unknown", "sagittal", "coronal", "axial")
#: Pieces that a gradient is cut into for its sums, and studies whose gradient a task works out at once.
PIECES, STUDIES = 16, 32


@dataclass(frozen=True)
class Shape:
    slots: int
    slices: int
    dim: int
    columns: tuple[str, ...]
    hidden: int = 32
    gates: int = 16

    def parameters(self) -> dict[str, tuple[int, ...]]:
        pool = {"v": (self.gates, self.hidden), "v_bias": (self.gates,), "u": (self.gates, self.hidden), "u_bias": (self.gates,), "w": (self.gates,)}
        first = {"norm": (self.dim,), "norm_bias": (self.dim,), "proj": (self.hidden, self.dim), "proj_bias": (self.hidden,)}
        last = {"plane": (len(PLANES), self.hidden), "head": (len(self.columns), self.hidden), "head_bias": (len(self.columns),)}
        return first | {f"slice_{k}": s for k, s in pool.items()} | {f"series_{k}": s for k, s in pool.items()} | last

    def size(self) -> int:
        return sum(math.prod(s) for s in self.parameters().values())

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parameters().items():
            out[name] = flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return out

    def pack(self, parts: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([np.ravel(parts[n]) for n in self.parameters()])

    def initial(self, seed: int) -> np.ndarray:
        """Uniform in plus or minus the root of what a unit reads; the planes' vectors are zeros."""
        rng, out = np.random.default_rng(seed), {}
        for name, shape in self.parameters().items():
            reads = {"proj": self.dim, "proj_bias": self.dim}.get(name, self.gates if name.endswith("_w") else self.hidden)
            out[name] = rng.uniform(-1, 1, shape) / math.sqrt(reads)
        return self.pack(out | {"plane": np.zeros((len(PLANES), self.hidden)), "norm": np.ones(self.dim), "norm_bias": np.zeros(self.dim)})


@dataclass(frozen=True)
class Training:
    epochs: int = 60
    batches: int = 4
    rate: float = 1e-3
    decay: float = 1e-2
    warm: float = 0.2
    dropout: float = 0.3
    slice_dropout: float = 0.1
    noise: float = 0.05
    seed: int = 0


# One study after the other, in numpy: forward, and backward to the parameters.


def _erf(x: np.ndarray) -> np.ndarray:
    """To about 1e-7 (a well-known approximation by five powers)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    y = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x)
    return np.sign(x) * y


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _pool(h: np.ndarray, keep: np.ndarray, p: dict, name: str):
    """The attention-weighted mean of h (n, t, hidden) over what is kept, and what its gradient needs."""
    t = np.tanh(h @ p[f"{name}_v"].T + p[f"{name}_v_bias"])
    s = _sigmoid(h @ p[f"{name}_u"].T + p[f"{name}_u_bias"])
    some = keep.any(1, keepdims=True)
    e = np.where(keep, (t * s) @ p[f"{name}_w"], -np.inf)
    e = np.where(some, e, 0.0)
    a = np.exp(e - e.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    return np.einsum("nt,nth->nh", a, h), (h, t, s, a, some)


def _pool_back(d: np.ndarray, held, p: dict, name: str, g: dict) -> np.ndarray:
    h, t, s, a, some = held
    da = np.einsum("nh,nth->nt", d, h)
    de = np.where(some, a * (da - (a * da).sum(1, keepdims=True)), 0.0)
    g[f"{name}_w"] = np.einsum("nt,nta->a", de, t * s)
    both = de[..., None] * p[f"{name}_w"]
    dt, ds = both * s * (1 - t * t), both * t * s * (1 - s)
    for k, x in (("v", dt), ("u", ds)):
        g[f"{name}_{k}"], g[f"{name}_{k}_bias"] = np.einsum("nta,nth->ah", x, h), x.sum((0, 1))
    return a[..., None] * d[:, None] + dt @ p[f"{name}_v"] + ds @ p[f"{name}_u"]


def forward(p: dict, b: dict, drop: np.ndarray | float = 1.0):
    """(logits, what the gradient needs) of studies: x (n, slots, slices, dim), there (n, slots, slices), series (n, slots), planes (n, slots)."""
    x = b["x"]
    n, slots, slices, dim = x.shape
    spread = x - x.mean(-1, keepdims=True)
    plain = spread / np.sqrt((spread * spread).mean(-1, keepdims=True) + 1e-5)
    y = plain * p["norm"] + p["norm_bias"]
    z = y @ p["proj"].T + p["proj_bias"]
    share = 0.5 * (1 + _erf(z / math.sqrt(2)))
    h = (z * share).reshape(n * slots, slices, -1)
    one, held_one = _pool(h, b["there"].reshape(n * slots, slices), p, "slice")
    series = one.reshape(n, slots, -1) + p["plane"][b["planes"]]
    two, held_two = _pool(series, b["series"], p, "series")
    out = two * drop
    return out @ p["head"].T + p["head_bias"], (plain, y, z, share, held_one, held_two, out, drop)


def gradient(shape: Shape, flat: np.ndarray, b: dict, drop: np.ndarray | float = 1.0) -> tuple[float, float, np.ndarray]:
    """(sum of weighted losses, sum of weights, gradient of the first) over studies with y and w (n, columns), y anything where w is 0."""
    p, g = shape.unpack(flat), {}
    logits, (plain, y, z, share, held_one, held_two, out, drop) = forward(p, b, drop)
    w, label = b["w"], np.where(b["w"] > 0, b["y"], 0.0)
    loss = np.maximum(logits, 0) - logits * label + np.log1p(np.exp(-np.abs(logits)))
    d = w * (_sigmoid(logits) - label)
    g["head"], g["head_bias"] = d.T @ out, d.sum(0)
    d = _pool_back((d @ p["head"]) * drop, held_two, p, "series", g)
    g["plane"] = np.zeros_like(p["plane"])
    np.add.at(g["plane"], b["planes"].ravel(), d.reshape(-1, d.shape[-1]))
    d = _pool_back(d.reshape(-1, d.shape[-1]), held_one, p, "slice", g).reshape(z.shape)
    d = d * (share + z * np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
    g["proj"], g["proj_bias"] = np.einsum("nsth,nstd->hd", d, y), d.sum((0, 1, 2))
    d = d @ p["proj"]
    g["norm"], g["norm_bias"] = (d * plain).sum((0, 1, 2)), d.sum((0, 1, 2))
    return float((w * loss).sum()), float(w.sum()), shape.pack(g)


def _studies(b: pa.RecordBatch, shape: Shape, labelled: bool) -> Iterator[tuple[list[int], dict]]:
    """(hashes of the studies, their arrays), STUDIES at a time."""
    for at in range(0, b.num_rows, STUDIES):
        part = b.slice(at, STUDIES)
        n = part.num_rows
        x = np.stack([np.frombuffer(v, np.float32) for v in part.column("x").to_pylist()]).astype(np.float64)
        out = {"x": x.reshape(n, shape.slots, shape.slices, shape.dim), "there": np.array(part.column("there").to_pylist(), dtype=bool).reshape(n, shape.slots, shape.slices), "planes": np.array(part.column("planes").to_pylist(), dtype=np.int64)}
        out["series"] = out["there"].any(2)
        if labelled:
            w = np.array([[v or 0.0 for v in r] for r in part.column("w").to_pylist()])
            y = np.array([[math.nan if v is None else v for v in r] for r in part.column("y").to_pylist()])
            out |= {"w": np.where(np.isnan(y), 0.0, w), "y": y}
        yield part.column("hash").to_pylist(), out


def _disturbed(b: dict, hashes: list[int], shape: Shape, c: Training, epoch: int) -> tuple[dict, np.ndarray]:
    """The studies with noise and without dropped slices (never a whole series), and the factors of dropout."""
    x, there, drop = b["x"].copy(), b["there"].copy(), np.ones((len(hashes), shape.hidden))
    for k, h in enumerate(hashes):
        rng = np.random.Generator(np.random.Philox(key=[h & (2**64 - 1), c.seed << 32 | epoch]))
        x[k] += c.noise * rng.normal(size=x[k].shape)
        kept = there[k] & (rng.random(there[k].shape) > c.slice_dropout)
        there[k] = np.where(kept.any(1, keepdims=True), kept, there[k])
        if c.dropout:
            drop[k] = (rng.random(shape.hidden) >= c.dropout) / (1 - c.dropout)
    return b | {"x": x, "there": there}, drop


# The Spark side


def bags(vectors: DataFrame, shape: Shape, key: str = "study") -> DataFrame:
    """key, x (32-bit floats), there, planes from rows of key, slot, slice, plane, x (array of floats). A study is at most slots x slices vectors; rows beyond them or of another length
    are no part of it."""
    rows = vectors.where(F.col("slot").between(0, shape.slots - 1) & F.col("slice").between(0, shape.slices - 1) & (F.size("x") == shape.dim))
    of = rows.groupBy(key).agg(F.collect_list(F.struct("slot", "slice", "plane", "x")).alias("v"))

    def run(batches):
        for b in batches:
            xs, there, planes = [], [], []
            for v in b.column("v"):
                s = v.values
                slot, cut = s.field("slot").to_numpy(), s.field("slice").to_numpy()
                x = np.zeros((shape.slots, shape.slices, shape.dim), dtype=np.float32)
                x[slot, cut] = s.field("x").flatten().to_numpy().reshape(len(slot), shape.dim)
                mask, codes = np.zeros((shape.slots, shape.slices), dtype=bool), np.zeros(shape.slots, dtype=np.int32)
                mask[slot, cut] = True
                codes[slot] = [PLANES.index(n) if n in PLANES else 0 for n in s.field("plane").to_pylist()]
                xs.append(x.tobytes())
                there.append(mask.ravel().tolist())
                planes.append(codes.tolist())
            yield pa.RecordBatch.from_pydict({key: b.column(key), "x": pa.array(xs, pa.binary()), "there": pa.array(there, pa.list_(pa.bool_())), "planes": pa.array(planes, pa.list_(pa.int32()))})

    return of.mapInArrow(run, f"`{key}` {dict(vectors.dtypes)[key]}, x binary, there array<boolean>, planes array<int>")


def with_targets(items: DataFrame, targets: DataFrame, shape: Shape, key: str = "study") -> DataFrame:
    """Adds y and w, an entry a column, from key, column, label, weight."""
    wide = targets.groupBy(key).agg(*[F.max(F.when(F.col("column") == c, F.col(n))).alias(f"{n}{k}") for k, c in enumerate(shape.columns) for n in ("label", "weight")])
    packed = wide.select(key, *[F.array(*[F.col(f"{n}{k}").cast("double") for k in range(len(shape.columns))]).alias(a) for n, a in (("label", "y"), ("weight", "w"))])
    return items.join(packed, key)


def rate_at(step: int, steps: int, c: Training) -> tuple[float, float]:
    """(learning rate, first moment's decay) of a one-cycle schedule: up to the rate over the share `warm` of the steps and down to next to nothing, along cosines; the decay
    goes the other way."""
    ends = [(c.warm * steps - 1, (c.rate / 25, c.rate), (0.95, 0.85)), (steps - 1, (c.rate, c.rate / 25e4), (0.85, 0.95))]
    begin = 0.0
    for end, rates, decays in ends:
        if step <= end or end == steps - 1:
            share = (step - begin) / (end - begin) if end > begin else 1.0
            between = lambda a, b: b + (a - b) / 2 * (1 + math.cos(math.pi * share))  # noqa: B023, E731
            return between(*rates), between(*decays)
        begin = end
    raise AssertionError


def summed_gradients(rows: DataFrame, shape: Shape, models: np.ndarray, c: Training, epoch: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each model the sums of losses and of weights, and the gradient of the loss, over the studies whose fold isn't the model's number. Without an epoch nothing is
    drawn."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        own = shared.value
        sums = [[0.0, 0.0, np.zeros(shape.size())] for _ in own]
        for b in batches:
            folds = np.array(b.column("fold").to_pylist())
            for at, (hashes, studies) in enumerate(_studies(b, shape, True)):
                drop: np.ndarray | float = 1.0
                if epoch is not None:
                    studies, drop = _disturbed(studies, hashes, shape, c, epoch)
                fold = folds[at * STUDIES : (at + 1) * STUDIES]
                for k, flat in enumerate(own):
                    mine = fold != k
                    if mine.any():
                        loss, weight, g = gradient(shape, flat, {n: v[mine] for n, v in studies.items()}, drop[mine] if isinstance(drop, np.ndarray) else drop)
                        sums[k][0] += loss
                        sums[k][1] += weight
                        sums[k][2] += g
        pieces = [(k, i, loss, weight, part.tobytes()) for k, (loss, weight, g) in enumerate(sums) if weight for i, part in enumerate(np.array_split(g, PIECES))]
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*pieces, strict=True)], names=["model", "piece", "loss", "weight", "g"])

    def add(batches):
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["g"])
                at = sums.setdefault((r["model"], r["piece"]), [0.0, 0.0, np.zeros(len(x))])
                at[0] += r["loss"]
                at[1] += r["weight"]
                at[2] = at[2] + x
        if sums:
            rows = [(k, i, loss, weight, g.tobytes()) for (k, i), (loss, weight, g) in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows, strict=True)], names=["model", "piece", "loss", "weight", "g"])

    schema = "model bigint, piece bigint, loss double, weight double, g binary"
    found = rows.select("hash", "fold", "x", "there", "planes", "y", "w").mapInArrow(run, schema).repartition("model", "piece").mapInArrow(add, schema).collect()  # one gradient a model
    shared.unpersist()
    loss, weight, g = np.zeros(len(models)), np.zeros(len(models)), np.zeros_like(models)
    cuts = np.cumsum([0, *[len(x) for x in np.array_split(models[0], PIECES)]])
    for r in found:
        loss[r.model], weight[r.model] = r.loss, r.weight
        g[r.model, cuts[r.piece] : cuts[r.piece + 1]] = np.frombuffer(r.g)
    return loss, weight, g


def train(items: DataFrame, shape: Shape, folds: int, c: Training = Training(), start: np.ndarray | None = None, frozen: tuple[str, ...] = (), key: str = "study", report: list | None = None) -> np.ndarray:
    """The models of `folds` folds, a row of parameters each, from key, fold, x, there, planes, y, w. A study of fold k is left out of model k; a fold of -1 is in all. `start` continues earlier
    models, and `frozen` parameters (by the beginning of their names) stay. `report` takes each epoch's mean losses."""
    spark = items.sparkSession
    path = new_folder(spark, "bags")
    # a study's number in its draws doesn't depend on where it lies
    hashed = items.select(F.xxhash64(F.col(key).cast("string")).alias("hash"), "fold", "x", "there", "planes", "y", "w").withColumn("batch", F.pmod("hash", F.lit(c.batches)).cast("int"))
    hashed.write.partitionBy("batch").parquet(path)
    rows = spark.read.schema(hashed.schema).parquet(path)
    models = np.stack([shape.initial(c.seed + k) for k in range(folds)]) if start is None else np.array(start, dtype=np.float64)
    moves = np.concatenate([np.full(math.prod(s), not n.startswith(frozen) if frozen else True) for n, s in shape.parameters().items()])
    first, second = np.zeros_like(models), np.zeros_like(models)
    steps, step = c.epochs * c.batches, 0
    order = np.random.default_rng(c.seed)
    try:
        for epoch in range(c.epochs):
            losses = []
            for batch in order.permutation(c.batches).tolist():
                loss, weight, g = summed_gradients(rows.where(F.col("batch") == batch), shape, models, c, epoch)
                rate, decay = rate_at(step, steps, c)
                step += 1
                g = g / np.maximum(weight, 1.0)[:, None]
                losses.append(loss / np.maximum(weight, 1.0))
                first, second = decay * first + (1 - decay) * g, 0.999 * second + 0.001 * g * g
                moved = models * (1 - rate * c.decay) - rate * (first / (1 - decay**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                models = np.where(moves, moved, models)
            if report is not None:
                report.append(np.mean(losses, 0).tolist())
    finally:
        remove(spark, path)
    return models


def predict(items: DataFrame, shape: Shape, models: np.ndarray, fold: Column | None = None, key: str = "study") -> DataFrame:
    """key, column, p: the mean probability of the models, or that of the study's own fold's model."""
    shared = items.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        own = shared.value
        for b in batches:
            folds, at = b.column("fold").to_pylist(), 0
            for hashes, studies in _studies(b, shape, False):
                p = np.stack([_sigmoid(forward(shape.unpack(m), studies)[0]) for m in own])
                mine = [p[f, k] if f is not None else p[:, k].mean(0) for k, f in enumerate(folds[at : at + len(hashes)])]
                yield pa.RecordBatch.from_pydict({key: b.column(key).slice(at, len(hashes)), "p": pa.array([x.tolist() for x in mine], pa.list_(pa.float64()))})
                at += len(hashes)

    rows = items.select(key, "x", "there", "planes", F.lit(0).cast("bigint").alias("hash"), (F.lit(None) if fold is None else fold).cast("int").alias("fold"))
    out = rows.mapInArrow(run, f"`{key}` {dict(items.dtypes)[key]}, p array<double>")
    cells = F.arrays_zip(F.array(*map(F.lit, shape.columns)).alias("column"), F.col("p").alias("p"))
    return out.select(key, F.explode(cells).alias("c")).select(key, "c.column", "c.p")


def out_of_fold(items: DataFrame, shape: Shape, folds: int, c: Training = Training(), key: str = "study") -> DataFrame:
    """key, column, p by the model that the study's fold was left out of."""
    return predict(items, shape, train(items, shape, folds, c, key=key), F.col("fold"), key)


def save_head(spark: SparkSession, shape: Shape, models: np.ndarray, path: str) -> None:
    """The shape, and a row of 64-bit floats a model."""
    rows = [(json.dumps(asdict(shape)), k, bytearray(m.astype("<f8").tobytes())) for k, m in enumerate(models)]
    spark.createDataFrame(rows, "shape string, fold int, parameters binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_head(spark: SparkSession, path: str) -> tuple[Shape, np.ndarray]:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.fold)
    told = json.loads(rows[0]["shape"])
    return Shape(**told | {"columns": tuple(told["columns"])}), np.stack([np.frombuffer(r.parameters, "<f8") for r in rows])
