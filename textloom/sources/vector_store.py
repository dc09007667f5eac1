"""A store of vectors in half precision, sorted by key, with a fence index: a lookup reads the row groups that may hold its keys.

Vectors are little-endian half-precision numbers in a binary column. Files hold ranges of keys; the fence table has each file's first and last key.
Row groups are small, and their bounds in the file's footer leave out all but those around a key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialise

#: Bytes of a row group, and keys that a lookup may name; more are a join.
GROUP_BYTES, MOST_KEYS = 1 << 20, 10_000
#: Beyond this a number has no half-precision form.
MOST = 65504.0


def encode(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, length, half): vectors rounded to half precision. A number that is too large, missing or not one is an error; so is a null key."""

    def run(batches):
        for batch in batches:
            halves, lengths = [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array(v if v is not None else [np.nan], np.float64)
                if k is None or not np.isfinite(x).all() or np.abs(x).max(initial=0) > MOST:
                    raise ValueError(f"the vector of {k!r} has no half-precision form")
                halves.append(x.astype("<f2").tobytes())
                lengths.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32()), pa.array(halves, pa.binary())], [key, "length", "half"])

    return vectors.select(F.col(key).cast("string").alias(key), F.col(vec).cast("array<double>").alias("vec")).mapInArrow(run, f"{key} string, length int, half binary")


def decode(stored: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, vec): the vectors as single-precision numbers, which hold every half exactly."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(h, "<f2").astype(np.float32) for h in batch.column(1).to_pylist()], pa.list_(pa.float32()))], [key, vec])

    return stored.select(key, "half").mapInArrow(run, f"{key} string, {vec} array<float>")


def write(vectors: DataFrame, path: str, key: str, vec: str, files: int = 16) -> None:
    """A new store at ``path``, which must not be there. A key with several vectors has the first of them by its bytes; ``merge`` orders stores."""
    _write(encode(vectors, key, vec).groupBy(key).agg(F.min(F.struct("half", "length")).alias("x")).select(key, "x.length", "x.half"), path, key, files)


def _write(stored: DataFrame, path: str, key: str, files: int) -> None:
    """Sorted by ranges of keys, then the fences of the files that were written."""
    sorted_ = materialise(stored, "vectors").repartitionByRange(files, key).sortWithinPartitions(key)
    sorted_.write.option("parquet.block.size", GROUP_BYTES).option("parquet.block.size.row.check.min", 64).parquet(f"{path}/vectors")
    written = stored.sparkSession.read.parquet(f"{path}/vectors")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")
    written.select(key, name).groupBy("file").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows")).coalesce(1).write.parquet(f"{path}/fences")


def files_of(spark: SparkSession, path: str, keys: list[str]) -> list[str]:
    """The files whose range holds one of ``keys``."""
    wanted = F.array(*map(F.lit, keys)).cast("array<string>")
    fences = spark.read.parquet(f"{path}/fences").where(F.exists(wanted, lambda k: (k >= F.col("first")) & (k <= F.col("last"))))
    return sorted(r.file for r in fences.select("file").collect())  # of a bounded number of keys, at most as many files


def lookup(spark: SparkSession, path: str, keys: list[str], key: str, vec: str = "vec") -> DataFrame:
    """(key, vec) of the keys that the store has. Only files and row groups whose ranges hold one are read."""
    if len(keys) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys; join the store with them")
    files = files_of(spark, path, keys)
    if not files:
        return spark.createDataFrame([], f"{key} string, {vec} array<float>")
    rows = spark.read.parquet(*[f"{path}/vectors/{f}" for f in files]).where(F.col(key).isin(keys))
    return decode(rows, key, vec)


def load(spark: SparkSession, path: str, key: str, vec: str = "vec") -> DataFrame:
    return decode(spark.read.parquet(f"{path}/vectors"), key, vec)


def merge(spark: SparkSession, parts: list[str], path: str, key: str, files: int = 16) -> None:
    """One store of several: a key that several have keeps the vector of the first, as it is stored."""
    every = None
    for number, part in enumerate(parts):
        one = spark.read.parquet(f"{part}/vectors").withColumn("_part", F.lit(number))
        every = one if every is None else every.unionByName(one)
    _write(every.groupBy(key).agg(F.min_by(F.struct("length", "half"), "_part").alias("x")).select(key, "x.length", "x.half"), path, key, files)
