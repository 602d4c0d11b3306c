"""A content-keyed store: what a configuration made of each key is computed once and appended."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.utils import AnalysisException

from .shared import remove, written


def config_key(config: dict) -> str:
    """12 hex digits of the configuration's sorted JSON."""
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def config_key_of(**fields: Column) -> Column:
    """config_key of configurations that are rows: fields of numbers and of texts without quotes, backslashes or other signs that JSON escapes."""
    text = lambda c: F.when(F.typeof(c) == "string", F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(c.cast("string"))
    parts = [F.concat(F.lit(f'"{n}": '), F.coalesce(text(c), F.lit("null"))) for n, c in sorted(fields.items())]
    return F.left(F.sha1(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))), F.lit(12))


def shard_key(key: Column) -> Column:
    return F.left(F.sha1(key.cast("string")), F.lit(2))


class Store:
    """Parquet below root/<config key>, partitioned by shard. Writes append whole files, so a lost task leaves nothing half done."""

    def __init__(self, spark: SparkSession, root: str, config: dict, key: str = "doc_id", right: Column | None = None):
        """right: what a stored row must satisfy, such as a vector's size; rows that don't are misses and are computed again."""
        self.spark, self.key, self.right, self.path = spark, key, right, f"{root.rstrip('/')}/{config_key(config)}"

    def read(self) -> DataFrame | None:
        """The stored rows, None before anything is stored. A corrupt file is an error, as what it held would be lost unseen."""
        try:
            rows = self.spark.read.parquet(self.path)
        except AnalysisException:
            return None
        return rows if self.right is None else rows.where(self.right)

    def missing(self, rows: DataFrame) -> DataFrame:
        have = self.read()
        return rows if have is None else rows.join(have.select(self.key).distinct(), self.key, "left_anti")

    def get(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stored results for rows; those that are missing are computed and appended first."""
        todo = self.missing(rows)
        if self.read() is None or not todo.isEmpty():
            self._append(compute(todo))
        return self.read().join(rows.select(self.key).distinct(), self.key, "left_semi").drop("shard")

    def _append(self, made: DataFrame) -> None:
        # shards are gathered first, and large ones split, so that files are neither many nor huge
        made.withColumn("shard", shard_key(F.col(self.key))).hint("rebalance", "shard").write.mode("append").partitionBy("shard").parquet(self.path)

    def failures(self) -> DataFrame | None:
        """What `build` couldn't make: key, error, at; a row for each attempt. None before the first."""
        try:
            return self.spark.read.parquet(f"{self.path}-failed")
        except AnalysisException:
            return None

    def build(self, rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str, attempts: int | None = None) -> tuple[int, int]:
        """(how many keys were made, how many failed). `work` makes the stored rows of one key (columns of `schema`, the key among them) from its input rows. A key whose work raises becomes a row of
        `failures`; all others are stored, and the next call takes only what isn't, without those that have failed `attempts` times. What a lost task or driver had not appended is
        worked out again."""
        todo = self.missing(rows)
        if attempts is not None and (bad := self.failures()) is not None:
            todo = todo.join(bad.groupBy(self.key).count().where(F.col("count") >= attempts).select(self.key), self.key, "left_anti")
        fields = self.spark.createDataFrame([], schema).schema
        key, names, arrow = self.key, fields.names, to_arrow_schema(fields)

        def guarded(group: pa.Table) -> pa.Table:
            try:
                made = work(group).select(names)
                return made.append_column("_error", pa.nulls(made.num_rows, pa.string()))
            except Exception as failed:  # what one key can't do is that key's row, and no other's loss
                text = f"{type(failed).__name__}: {failed}"[:500]
                return pa.table({n: group.column(key)[:1] if n == key else pa.nulls(1, arrow.field(n).type) for n in names} | {"_error": pa.array([text])})

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        made = written(todo.groupBy(self.key).applyInArrow(guarded, kinds + ", `_error` string"), "built")
        good, bad = made.where("_error IS NULL").drop("_error"), made.where("_error IS NOT NULL")
        self._append(good)
        failed = bad.select(self.key, F.col("_error").alias("error"), F.current_timestamp().alias("at"))
        if n := failed.count():
            failed.write.mode("append").parquet(f"{self.path}-failed")
        done = good.select(self.key).distinct().count()
        for path in {f.rsplit("/", 1)[0] for f in made.inputFiles()}:
            remove(self.spark, path)
        return done, n


def extract(store: Store, rows: DataFrame, x: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = 64, shape: list[int] | None = None) -> DataFrame:
    """key and features of rows, through the store: what isn't in it is computed by the encoder that `load` returns, batch by batch, and appended. The encoder is loaded once a Python worker,
    and a second call computes nothing. A null input has null features, which are stored too."""
    encode = predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[shape] if shape else None)

    def compute(missing: DataFrame) -> DataFrame:
        some = missing.where(F.col(x).isNotNull()).select(store.key, encode(F.col(x)).alias("features"))
        return some.unionByName(missing.where(F.col(x).isNull()).select(store.key, F.lit(None).cast("array<float>").alias("features")))

    return store.get(rows.select(store.key, x), compute)
