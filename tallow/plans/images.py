"""Queries on images: small ones made of the events, a series a user and a slice an event. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels
from ..operators.series import uniform
from . import views as V

QUERIES: dict = {}
HEIGHT, WIDTH, SIDE, SMALL = 6, 5, 6, 4
CONFIG = pixels.Augment()


def query(f):
    QUERIES[f.__name__] = f
    return f


def images(s: SparkSession, d: str, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """event_id, user_id, height, width, pixels: byte j of event e is (31 e + 17 j (j + e % 5)) % 256."""
    j, e = F.sequence(F.lit(0), F.lit(height * width - 1)), F.col("event_id")
    digits = F.transform(j, lambda k: F.lpad(F.hex((e * 31 + k * (k + e % 5) * 17) % 256), 2, "0"))
    return V.slices(s, d).select("event_id", "user_id", F.lit(height).alias("height"), F.lit(width).alias("width"), F.unhex(F.array_join(digits, "")).alias("pixels"))


def _bytes(n: int) -> str:
    return f"list_transform(range({n}), lambda j: (event_id * 31 + j * (j + event_id % 5) * 17) % 256)"


def _samples(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", F.lower(F.hex("pixels")).alias("pixels"))


@query
def image_resize(s, d):
    return _samples(pixels.resize(images(s, d), SMALL))


def _weights(n_in: int, n_out: int, filter_: str, radius: int) -> str:
    """SQL: i, k, w of the weights of input sample k for output sample i."""
    wide = max(n_in / n_out, 1.0)
    return f"""SELECT i, k, f / sum(f) OVER (PARTITION BY i) AS w FROM (SELECT i, k, {filter_} AS f FROM (SELECT i, k, abs((k - c + 0.5) / {wide}::DOUBLE) AS x
 FROM (SELECT i, (i + 0.5) * ({n_in / n_out}::DOUBLE) AS c FROM range({n_out}) AS o(i)), range({n_in}) AS n(k)
 WHERE k >= greatest(trunc(c - {radius * wide}::DOUBLE + 0.5), 0) AND k < least(trunc(c + {radius * wide}::DOUBLE + 0.5), {n_in})))"""


TRIANGLE, CUBIC = "greatest(0, 1 - x)", "CASE WHEN x < 1 THEN (1.5 * x - 2.5) * x * x + 1 WHEN x < 2 THEN -0.5 * (((x - 5) * x + 8) * x - 4) ELSE 0 END"
_HEX = "lower(string_agg(printf('%02x', v), '' ORDER BY y, x))"


def _resize_sql() -> str:
    whole = f"floor(0.5 + w * {1 << 22})::BIGINT"
    sums = lambda v: f"(sum({v} * {whole})::BIGINT + {1 << 21}) >> 22"
    return f"""WITH a AS ({_weights(WIDTH, SMALL, TRIANGLE, 1)}), b AS ({_weights(HEIGHT, SMALL, TRIANGLE, 1)}),
p AS (SELECT event_id, unnest(range({HEIGHT * WIDTH})) AS j, unnest({_bytes(HEIGHT * WIDTH)}) AS v FROM events),
h AS (SELECT event_id, j // {WIDTH} AS y, a.i AS x, {sums('v')} AS v FROM p JOIN a ON a.k = j % {WIDTH} GROUP BY ALL),
r AS (SELECT event_id, b.i AS y, x, {sums('v')} AS v FROM h JOIN b ON b.k = h.y GROUP BY event_id, b.i, x)
SELECT event_id, {_HEX} AS pixels FROM r GROUP BY event_id"""


@query
def image_warp(s, d):
    part = lambda name, most: (2 * uniform(F.col("user_id"), F.lit(name)) - 1) * most
    matrix = pixels.turn_matrix(F.col("width"), part("turn", 40), 1 + part("scale", 0.2), part("right", 0.8), part("down", 0.8))
    return _samples(pixels.warp(images(s, d, SIDE, SIDE).withColumn("matrix", matrix)))


def _part(name: str, most: float, by: str = "user_id") -> str:
    return f"((2 * (('0x' || substr(md5(concat_ws(':', {by}, '{name}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE) - 1) * {most})"


def _warp_sql() -> str:
    n, c = SIDE, SIDE / 2
    at = lambda y, x: f"p[{y} * {n} + {x} + 1]"
    row = lambda y: f"({at(y, 'x0')} + ({at(y, 'x1')} - {at(y, 'x0')}) * dx)"
    return f"""WITH m AS (SELECT event_id, {_bytes(n * n)} AS p, round(cos(radians({_part('turn', 40)})), 15) / (1 + {_part('scale', 0.2)}) AS a, round(sin(radians({_part('turn', 40)})), 15) / (1 + {_part('scale', 0.2)}) AS b, {_part('right', 0.8)} AS tx, {_part('down', 0.8)} AS ty FROM events),
o AS (SELECT *, unnest(range({n * n})) AS j FROM m),
u AS (SELECT event_id, p, j // {n} AS y, j % {n} AS x, a * (j % {n} + 0.5) + b * (j // {n} + 0.5) + ({c} - a * {c} - b * {c} + tx) AS u, -b * (j % {n} + 0.5) + a * (j // {n} + 0.5) + ({c} + b * {c} - a * {c} + ty) AS v FROM o),
f AS (SELECT *, floor(u - 0.5)::INT AS l, floor(v - 0.5)::INT AS t, u - 0.5 - floor(u - 0.5) AS dx, v - 0.5 - floor(v - 0.5) AS dy, u >= 0 AND u < {n} AND v >= 0 AND v < {n} AS inside FROM u),
g AS (SELECT *, greatest(0, least({n - 1}, l)) AS x0, greatest(0, least({n - 1}, l + 1)) AS x1, greatest(0, least({n - 1}, t)) AS y0, greatest(0, least({n - 1}, t + 1)) AS y1 FROM f),
r AS (SELECT event_id, x, y, CASE WHEN inside THEN trunc({row('y0')} + ({row('y1')} - {row('y0')}) * dy)::INT ELSE 0 END AS v FROM g)
SELECT event_id, {_HEX} AS pixels FROM r GROUP BY event_id"""


@query
def image_field(s, d):
    """A smooth field's factors at the corners and in the middle, and their mean."""
    rows = V.slices(s, d).select("event_id", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), F.array(*[2 * uniform(F.col("event_id"), F.lit(f"g{k}")) - 1 for k in range(16)]).alias("grid"))
    at = {"first": 0, "middle": 12, "last": HEIGHT * WIDTH - 1}
    out = pixels.bias_field(rows, 0.2)
    return out.select("event_id", *[F.round(F.get("field", F.lit(k)), 6).alias(n) for n, k in at.items()], F.round(F.aggregate("field", F.lit(0.0), lambda a, x: a + x) / (HEIGHT * WIDTH), 6).alias("mean"))


def _field_sql() -> str:
    grid = "[" + ", ".join(_part(f"g{k}", 1, "event_id") for k in range(16)) + "]"
    return f"""WITH a AS MATERIALIZED (SELECT i, list(w ORDER BY k) AS w FROM (SELECT i, k, coalesce(w, 0) AS w FROM (SELECT i, k FROM range({WIDTH}) AS o(i), range(4) AS n(k)) LEFT JOIN ({_weights(4, WIDTH, CUBIC, 2)}) q USING (i, k)) GROUP BY i),
b AS MATERIALIZED (SELECT i, list(w ORDER BY k) AS w FROM (SELECT i, k, coalesce(w, 0) AS w FROM (SELECT i, k FROM range({HEIGHT}) AS o(i), range(4) AS n(k)) LEFT JOIN ({_weights(4, HEIGHT, CUBIC, 2)}) q USING (i, k)) GROUP BY i),
g AS (SELECT event_id, {grid} AS g FROM events),
s AS (SELECT event_id, b.i * {WIDTH} + a.i AS j, list_sum(list_transform(range(16), lambda k: g[k + 1] * b.w[k // 4 + 1] * a.w[k % 4 + 1])) AS v FROM g, a, b),
f AS (SELECT event_id, j, 1 + 0.2 * v / max(abs(v)) OVER (PARTITION BY event_id) AS v FROM s)
SELECT event_id, round(any_value(v) FILTER (j = 0), 6) AS first, round(any_value(v) FILTER (j = 12), 6) AS middle, round(any_value(v) FILTER (j = {HEIGHT * WIDTH - 1}), 6) AS last, round(avg(v), 6) AS mean FROM f GROUP BY event_id"""


@query
def augment_draws(s, d):
    """Each user's parameters in two epochs."""
    rows = [pixels.draws(V.slices(s, d), ["user_id"], CONFIG, 7, epoch).withColumn("epoch", F.lit(epoch)) for epoch in (0, 1)]
    drawn = rows[0].unionByName(rows[1])
    names = ("degrees", "scale", "right", "down", "gamma", "contrast", "brightness")
    return drawn.select("user_id", "epoch", "applied", *[F.round(n, 9).alias(n) for n in names], F.round(F.get("grid", F.lit(5)), 6).alias("grid5"))


def _draws_sql() -> str:
    u = lambda *names: "(('0x' || substr(md5(concat_ws(':', '7', epoch, user_id, " + ", ".join(f"'{n}'" for n in names) + ")), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    spread = lambda n, most, add=0: f"round({add} + (2 * {u(n)} - 1) * {most}, 9) AS {n}"
    low, high = CONFIG.gamma
    return f"""SELECT user_id, epoch, {u('applied')} <= {CONFIG.p} AS applied, {spread('degrees', CONFIG.degrees)}, {spread('scale', CONFIG.scale, 1)}, {spread('right', CONFIG.shift)}, {spread('down', CONFIG.shift)},
 round({low} + {u('gamma')} * ({high} - {low}), 9) AS gamma, {spread('contrast', CONFIG.contrast, 1)}, {spread('brightness', CONFIG.brightness)}, round(sqrt(-2 * ln(1 - {u('grid5', 'u')})) * cos(2 * pi() * {u('grid5', 'v')}), 6) AS grid5
FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([0, 1])::INT AS epoch)"""


def values(s: SparkSession, d: str) -> DataFrame:
    """Slices of 2 x 3 samples; one in eleven is unreadable, and one series in five holds a single value a slice."""
    e = F.col("event_id")
    x = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.when(F.col("user_id") % 5 == 2, F.lit(7.0)).otherwise((e * 13 + j * j * 29) % 997 / 4.0).cast("float"))
    return V.slices(s, d).select("event_id", "user_id", F.lit(2).alias("height"), F.lit(3).alias("width"), F.when(e % 11 != 7, x).alias("values"))


@query
def clip_pixels(s, d):
    return _samples(pixels.clip_series(values(s, d), ["user_id"], "event_id"))


#: Series of single values have zeros where slices can't be read; if those are more than a hundredth, the percentiles differ, and the value is the top.
CLIP = """WITH v AS (SELECT event_id, user_id, unnest(range(6)) AS j FROM events),
p AS (SELECT event_id, user_id, j, CASE WHEN event_id % 11 = 7 THEN 0 WHEN user_id % 5 = 2 THEN 7 ELSE (event_id * 13 + j * j * 29) % 997 / 4.0 END::DOUBLE AS v FROM v),
r AS (SELECT user_id FROM events WHERE event_id % 11 <> 7 GROUP BY user_id),
q AS (SELECT user_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM p SEMI JOIN r USING (user_id) GROUP BY user_id),
t AS (SELECT event_id, j, CASE WHEN hi > lo THEN round_even((greatest(least(v, hi), lo) - lo) / (hi - lo) * 255, 0)::INT ELSE 0 END AS v FROM p JOIN q USING (user_id))
SELECT event_id, lower(string_agg(printf('%02x', v), '' ORDER BY j)) AS pixels FROM t GROUP BY event_id"""

ORACLES = {"image_resize": _resize_sql(), "image_warp": _warp_sql(), "image_field": _field_sql(), "augment_draws": _draws_sql(), "clip_pixels": CLIP}
