"""Small helpers that several operators use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import BATCH, bounded_batches, materialise, shared_folder  # noqa: F401


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


SALTS = 16


def join_salted(rows: DataFrame, few: DataFrame, keys: list[str], spread: str, how: str = "inner", salt: str = "_salt", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with the smaller ``few``, whose rows repeat for each of ``salts``; ``spread`` is a hash that deals the rows of a key.

    A key that a third of the rows have goes to as many tasks. Where Spark finds ``few`` small, it broadcasts it. ``spread`` goes, and
    the salt too unless a semi join keeps it.
    """
    salted = rows.withColumn(salt, F.pmod(F.col(spread), F.lit(salts)).cast("int")).drop(spread)
    repeated = few.withColumn(salt, F.explode(F.array(*map(F.lit, range(salts)))))
    out = salted.join(repeated, [*keys, salt], how)
    return out if how == "left_semi" else out.drop(salt)


def text_of(column: str = "text"):
    """The text, a null being the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
