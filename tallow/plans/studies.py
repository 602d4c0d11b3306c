"""Queries from slices to training items: volumes, items, stores and trained heads, each with its SQL where there is one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import heads, items, pixels, ranks
from ..sources import shared
from ..sources.store import Store, extract
from . import images as I
from . import views as V

QUERIES: dict = {}
POOL, PICK, SMALL, SLOTS = 4, 3, 2, 2


def query(f):
    QUERIES[f.__name__] = f
    return f


def _kept(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """df written, and the folders that it was made from removed."""
    out = shared.written(df, name)
    for f in folders:
        shared.remove(df.sparkSession, f)
    return out


# Volumes: a study a user, three series each (by event number), of which the first two are kept.


@query
def study_volumes(s: SparkSession, d: str) -> DataFrame:
    """Stored volumes, read back: a row a slot, with the samples as digits."""
    u, kind = F.col("user_id"), F.col("event_id") % 3
    uid = F.concat_ws("-", F.lpad(u.cast("string"), 9, "0"), kind)
    slices = I.values(s, d).select(u.alias("study"), uid.alias("uid"), F.element_at(F.array(F.lit("sagittal"), F.lit("coronal"), F.lit("oblique")), (kind + 1).cast("int")).alias("plane"), F.when(u % 3 > 0, F.when(u % 3 == 1, "L").otherwise("R")).alias("side"), "height", "width", "values", "event_id")
    picked = slices.groupBy("study").agg(F.slice(F.array_sort(F.collect_set("uid")), 1, SLOTS).alias("uids"))  # three uids at most
    made = items.volumes(slices, picked, POOL, SMALL, SLOTS, ["event_id"])
    root = shared.new_folder(s, "volumes")
    store = Store(s, root, {"n": POOL, "size": SMALL}, key="study", right=F.forall("slots", lambda x: F.octet_length(x["pixels"]) == POOL * SMALL * SMALL))
    whole = made.groupBy("study").agg(F.array_sort(F.collect_list(F.struct("slot", "uid", "mask", "plane", "side", "pixels"))).alias("slots"))
    back = store.get(picked.select("study"), lambda todo: whole.join(todo, "study", "left_semi"))
    out = back.select("study", F.explode("slots").alias("x")).select("study", "x.slot", "x.uid", "x.mask", "x.plane", "x.side", F.lower(F.hex("x.pixels")).alias("pixels"))
    return _kept(out, "volume-slots", root)


def _volumes_sql() -> str:
    sums = f"(sum(v * floor(0.5 + w * {1 << 22})::BIGINT)::BIGINT + {1 << 21}) >> 22"
    at = f"round_even(k * ((n - 1) / {POOL - 1}.0::DOUBLE), 0)::INT"
    return f"""WITH e AS (SELECT user_id AS study, lpad(user_id::VARCHAR, 9, '0') || '-' || event_id % 3 AS uid, event_id, event_id % 3 AS kind, event_id % 11 = 7 AS lost FROM events),
o AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY uid) AS n FROM e WINDOW w AS (PARTITION BY uid ORDER BY event_id)),
t AS (SELECT uid, k AS position, CASE WHEN n > 1 THEN {at} ELSE 0 END AS i FROM (SELECT DISTINCT uid, n FROM o), range({POOL}) AS q(k)),
x AS (SELECT o.study, o.uid, o.kind, t.position, o.event_id, o.lost FROM o JOIN t USING (uid, i)),
r AS (SELECT uid FROM x GROUP BY uid HAVING bool_or(NOT lost)),
p AS (SELECT x.*, j, CASE WHEN lost THEN 0 WHEN study % 5 = 2 THEN 7 ELSE (event_id * 13 + j * j * 29) % 997 / 4.0 END::DOUBLE AS v FROM x SEMI JOIN r USING (uid), range(6) AS q(j)),
q AS (SELECT uid, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM p GROUP BY uid),
c AS (SELECT study, uid, kind, position, j // 3 AS y, j % 3 AS k, CASE WHEN hi > lo THEN round_even((greatest(least(v, hi), lo) - lo) / (hi - lo) * 255, 0)::INT ELSE 0 END AS v FROM p JOIN q USING (uid)),
z AS (SELECT study, uid, kind, position, y, a.i AS x, {sums} AS v FROM c JOIN ({I._weights(3, SMALL, I.TRIANGLE, 1)}) a USING (k) GROUP BY ALL),
m AS (SELECT uid, lower(string_agg(printf('%02x', v), '' ORDER BY CASE WHEN study % 3 = 1 AND kind = 0 THEN -position ELSE position END, y, CASE WHEN study % 3 = 1 AND kind = 1 THEN -x ELSE x END)) AS pixels FROM z GROUP BY uid),
g AS (SELECT study, uid, kind, row_number() OVER (PARTITION BY study ORDER BY uid) - 1 AS slot FROM (SELECT DISTINCT study, uid, kind FROM e)),
f AS (SELECT study, s AS slot FROM (SELECT DISTINCT study FROM e), range({SLOTS}) AS q(s))
SELECT f.study, f.slot::INT AS slot, CASE WHEN pixels IS NOT NULL THEN g.uid END AS uid, pixels IS NOT NULL AS mask, CASE WHEN pixels IS NULL THEN 'unknown' WHEN kind = 0 THEN 'sagittal' WHEN kind = 1 THEN 'coronal' ELSE 'unknown' END AS plane,
 CASE WHEN pixels IS NOT NULL THEN CASE f.study % 3 WHEN 1 THEN 'L' WHEN 2 THEN 'R' END END AS side, coalesce(pixels, repeat('00', {POOL * SMALL * SMALL})) AS pixels
FROM f LEFT JOIN g ON g.study = f.study AND g.slot = f.slot LEFT JOIN m ON m.uid = g.uid"""


# Items: a study a vector, two slots of four slices of one sample.


def _targets(s: SparkSession, d: str) -> DataFrame:
    """Whether a vector's label is even, and whether it is below three; unknown for every fourth vector, NaN for some, and of weight 0.5 for labels above 6."""
    rows = V.table(s, d, "embeddings").select(F.col("vec_id").alias("study"), F.col("label").alias("y"))
    y = F.array(F.struct(F.lit("even").alias("column"), (F.col("y") % 2 == 0).cast("double").alias("label")), F.struct(F.lit("low").alias("column"), F.when(F.col("study") % 5 == 1, F.lit(float("nan"))).otherwise((F.col("y") < 3).cast("double")).alias("label")))
    return rows.where("study % 4 > 0").select("study", F.explode(y).alias("t"), F.when(F.col("y") > 6, 0.5).otherwise(1.0).alias("weight")).select("study", "t.*", "weight")


@query
def training_items(s, d):
    v = V.table(s, d, "embeddings").select(F.col("vec_id").alias("study"), F.explode(F.array(F.lit(0), F.lit(1))).alias("slot"))
    digits = F.concat(*[F.lpad(F.hex((F.col("study") * 7 + F.col("slot") * 50 + k * 11) % 256), 2, "0") for k in range(POOL)])
    stored = v.where("study % 9 > 0").select("study", "slot", ((F.col("study") + F.col("slot")) % 3 > 0).alias("mask"), F.element_at(F.array(*map(F.lit, heads.PLANES)), ((F.col("study") + F.col("slot")) % 4 + 1).cast("int")).alias("plane"), F.unhex(digits).alias("pixels"))
    wanted = V.table(s, d, "embeddings").select(F.col("vec_id").alias("study"))
    out = items.training_items(wanted, stored, _targets(s, d), ["even", "low"], POOL, PICK, 1, 5, 2, 8, offset=0.25, jitter=0.4)
    return out.select("shard", F.round("at", 9).alias("at"), "study", *[F.lower(F.hex(F.get("pixels", F.lit(k)))).alias(f"pixels{k}") for k in (0, 1)], F.array_join(F.col("series_mask").cast("array<string>"), ",").alias("series_mask"), F.array_join("planes", ",").alias("planes"), *[F.get(n, F.lit(k)).alias(f"{n}{k}") for n in ("y", "mask") for k in (0, 1)])


def _items_sql() -> str:
    u = lambda *p: "(('0x' || substr(md5(concat_ws(':', " + ", ".join(p) + ")), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    taken = f"list_transform(range({PICK}), lambda k: greatest(0, least({POOL - 1}, round_even((k + 0.25 + (2 * {u(repr('5:2:jitter'), 'study', 'k')} - 1) * 0.4) * {(POOL - 1) / (PICK - 1)}::DOUBLE, 0)::INT)))"
    slot = lambda c: f"array_to_string(list_transform(t, lambda i: lower(printf('%02x', (study * 7 + {c * 50} + i * 11) % 256))), '')"
    known = "study % 4 > 0"
    low = f"{known} AND study % 5 <> 1"
    w = "CASE WHEN label > 6 THEN 0.5 ELSE 1 END"
    return f"""WITH v AS (SELECT vec_id AS study, label, {u(repr('5:2:order'), 'vec_id')} AS o FROM embeddings WHERE vec_id % 9 > 0), t AS (SELECT *, {taken} AS t FROM v)
SELECT floor(o * 8)::INT AS shard, round(o, 9) AS "at", study, {slot(0)} AS pixels0, {slot(1)} AS pixels1, concat(study % 3 > 0, ',', (study + 1) % 3 > 0) AS series_mask, concat(study % 4, ',', (study + 1) % 4) AS planes,
 CASE WHEN {known} THEN (label % 2 = 0)::INT ELSE 0 END::DOUBLE AS y0, CASE WHEN {low} THEN (label < 3)::INT ELSE 0 END::DOUBLE AS y1, CASE WHEN {known} THEN {w} ELSE 0 END::DOUBLE AS mask0, CASE WHEN {low} THEN {w} ELSE 0 END::DOUBLE AS mask1 FROM t"""


# Stores


@query
def tolerant_build(s, d):
    """Sums by user; one user in seven fails for good, and those with an odd number fail the first time."""
    folder, rows = shared.new_folder(s, "build"), V.slices(s, d).select("user_id", "value")

    def work(first: bool):
        def add(group: pa.Table) -> pa.Table:
            k = group.column("user_id")[0].as_py()
            if k % 7 == 3 or first and k % 2:
                raise ValueError(f"user {k}")
            return pa.table({"user_id": [k], "n": [group.num_rows]})

        return add

    store = Store(s, folder, {"sums": 1}, key="user_id")
    for first in (True, False):
        store.build(rows, work(first), "user_id long, n long")
    failed = store.failures()
    failed = failed.groupBy("user_id").agg(F.count("*").alias("attempts"), F.max("error").alias("error")) if failed is not None else s.createDataFrame([], "user_id long, attempts long, error string")
    out = store.read().select("user_id", "n").join(failed, "user_id", "full_outer").select("user_id", "n", F.coalesce("attempts", F.lit(0)).alias("attempts"), "error")
    return _kept(out, "build-report", folder)


BUILD = """SELECT user_id, CASE WHEN user_id % 7 <> 3 THEN count(*) END AS n, CASE WHEN user_id % 7 = 3 THEN 2 ELSE user_id % 2 END::BIGINT AS attempts, CASE WHEN user_id % 7 = 3 OR user_id % 2 = 1 THEN concat('ValueError: user ', user_id) END AS error FROM events GROUP BY user_id"""

ENCODER = [[((k * 7 + j * 3) % 5) - 2 for j in range(2)] for k in range(64)]


@query
def stored_features(s, d):
    """Features by an encoder that is loaded once a worker; half of the rows come first, the rest and nothing else the second time."""
    folder = shared.new_folder(s, "features")

    def load():
        weights = np.array(ENCODER, dtype=np.float64)
        return lambda x: (x.astype(np.float64) @ weights).astype(np.float32)

    rows = V.table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("float")).alias("x"))
    store = Store(s, folder, {"encoder": "fixed"}, key="vec_id", right=F.size("features") == 2)
    extract(store, rows.where("vec_id % 2 = 0"), "x", load, shape=[64])
    out = extract(store, rows, "x", load, shape=[64])
    return _kept(out.select("vec_id", *[F.round(F.get("features", F.lit(k)).cast("double"), 5).alias(f"f{k}") for k in (0, 1)]), "features-read", folder)


FEATURES = "SELECT vec_id, " + ", ".join(f"round(list_sum(list_transform(range(64), lambda k: embedding[k + 1]::DOUBLE * ([{', '.join(str(r[j]) for r in ENCODER)}])[k + 1]))::FLOAT::DOUBLE, 5) AS f{j}" for j in (0, 1)) + " FROM embeddings"

# Augmentation, without noise, which SQL can't draw

CONFIG = pixels.Augment(noise=0.0, dropout=0.3)


@query
def augmented_slices(s, d):
    rows = I.images(s, d, I.SIDE, I.SIDE)
    return I._samples(pixels.augment(rows, ["user_id"], "event_id", CONFIG, 7, 1))


def _augment_sql() -> str:
    n, c = I.SIDE, I.SIDE / 2
    u = lambda *names: "(('0x' || substr(md5(concat_ws(':', '7:1', user_id, " + ", ".join(f"'{x}'" for x in names) + ")), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    spread = lambda name, most: f"((2 * {u(name)} - 1) * {most})"
    normal = lambda k: f"sqrt(-2 * ln(1 - {u(f'grid{k}', 'u')})) * cos(2 * pi() * {u(f'grid{k}', 'v')})"
    at = lambda y, x: f"p[{y} * {n} + {x} + 1]"
    row = lambda y: f"({at(y, 'x0')} + ({at(y, 'x1')} - {at(y, 'x0')}) * dx)"
    scale = f"(1 + {spread('scale', CONFIG.scale)})"
    low, high = CONFIG.gamma
    weights = lambda name: f"{name} AS MATERIALIZED (SELECT i, list(w ORDER BY k) AS w FROM (SELECT i, k, coalesce(w, 0) AS w FROM (SELECT i, k FROM range({n}) AS o(i), range(4) AS n(k)) LEFT JOIN ({I._weights(4, n, I.CUBIC, 2)}) q USING (i, k)) GROUP BY i)"
    return f"""WITH {weights('wa')}, {weights('wb')},
d AS MATERIALIZED (SELECT user_id, {u('applied')} <= {CONFIG.p} AS applied, round(cos(radians({spread('degrees', CONFIG.degrees)})), 15) / {scale} AS a, round(sin(radians({spread('degrees', CONFIG.degrees)})), 15) / {scale} AS b, {spread('right', CONFIG.shift)} * {n} AS tx, {spread('down', CONFIG.shift)} * {n} AS ty,
 {low} + {u('gamma')} * ({high} - {low}) AS gamma, 1 + {spread('contrast', CONFIG.contrast)} AS contrast, {spread('brightness', CONFIG.brightness)} AS brightness, [{', '.join(normal(k) for k in range(16))}] AS g FROM (SELECT DISTINCT user_id FROM events)),
s AS (SELECT user_id, wb.i * {n} + wa.i AS j, list_sum(list_transform(range(16), lambda k: g[k + 1] * wb.w[k // 4 + 1] * wa.w[k % 4 + 1])) AS v FROM d, wa, wb),
f AS (SELECT user_id, j, 1 + {CONFIG.field} * v / max(abs(v)) OVER (PARTITION BY user_id) AS field FROM s),
m AS (SELECT event_id, user_id, {I._bytes(n * n)} AS p FROM events),
o AS (SELECT m.*, d.* EXCLUDE (user_id), unnest(range({n * n})) AS j FROM m JOIN d USING (user_id)),
x AS (SELECT *, j // {n} AS y, j % {n} AS x, a * (j % {n} + 0.5) + b * (j // {n} + 0.5) + ({c} - a * {c} - b * {c} + tx) AS u, -b * (j % {n} + 0.5) + a * (j // {n} + 0.5) + ({c} + b * {c} - a * {c} + ty) AS v FROM o),
h AS (SELECT *, floor(u - 0.5)::INT AS l, floor(v - 0.5)::INT AS t, u - 0.5 - floor(u - 0.5) AS dx, v - 0.5 - floor(v - 0.5) AS dy, u >= 0 AND u < {n} AND v >= 0 AND v < {n} AS inside FROM x),
q AS (SELECT *, greatest(0, least({n - 1}, l)) AS x0, greatest(0, least({n - 1}, l + 1)) AS x1, greatest(0, least({n - 1}, t)) AS y0, greatest(0, least({n - 1}, t + 1)) AS y1 FROM h),
w AS (SELECT event_id, user_id, j, applied, gamma, contrast, brightness, CASE WHEN NOT applied THEN p[j + 1] WHEN inside THEN trunc({row('y0')} + ({row('y1')} - {row('y0')}) * dy) ELSE 0 END AS v FROM q),
b AS (SELECT *, pow(v / 255.0::DOUBLE, gamma) AS bent, avg(pow(v / 255.0::DOUBLE, gamma)) OVER (PARTITION BY user_id) AS mean FROM w),
dr AS (SELECT event_id, user_id, ('0x' || substr(md5(concat_ws(':', '7:1:dropout', user_id, event_id)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS r FROM events),
kept AS (SELECT event_id, count(*) OVER k <= 2 OR r >= {CONFIG.dropout} OR (max(r) OVER k < {CONFIG.dropout} AND r = max(r) OVER k) AS kept FROM dr WINDOW k AS (PARTITION BY user_id)),
z AS (SELECT event_id, j, CASE WHEN NOT applied THEN v WHEN NOT kept THEN 0 ELSE trunc(greatest(0, least(1, ((bent - mean) * contrast + mean + brightness) * field)) * 255) END::INT AS v FROM b JOIN f USING (user_id, j) JOIN kept USING (event_id))
SELECT event_id, lower(string_agg(printf('%02x', v), '' ORDER BY j)) AS pixels FROM z GROUP BY event_id"""


@query
def head_models(s, d):
    """Out-of-fold scores of bags of eight vectors, by heads trained on the other folds: whether any label is below two, and whether most are even."""
    k = F.col("vec_id")
    rows = V.table(s, d, "embeddings").select(F.floor(k / 8).alias("study"), (k % 2).cast("int").alias("slot"), (F.floor(k / 2) % 4).cast("int").alias("slice"), F.element_at(F.array(*map(F.lit, heads.PLANES)), (k % 2 + 1).cast("int")).alias("plane"), F.col("embedding").alias("x"), "label")
    shape = heads.Shape(2, 4, 64, ("low", "even"))
    sums = rows.groupBy("study").agg((F.min("label") < 2).cast("double").alias("low"), (2 * F.count_if(F.col("label") % 2 == 0) > F.count("*")).cast("double").alias("even"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("label")) for c in shape.columns])
    targets = sums.select("study", F.explode(cells).alias("c")).select("study", "c.*", F.lit(1.0).alias("weight"))
    bags = heads.with_targets(heads.bags(rows, shape), targets, shape)
    folds = ranks.kfold(bags.select(F.col("study").alias("doc_id")), 3).withColumnRenamed("doc_id", "study")
    return heads.out_of_fold(bags.join(folds, "study"), shape, 3, heads.Training(epochs=8, batches=1, rate=1e-2))


ORACLES = {"study_volumes": _volumes_sql(), "training_items": _items_sql(), "tolerant_build": BUILD, "stored_features": FEATURES, "augmented_slices": _augment_sql()}
