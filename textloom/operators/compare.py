"""Comparison of two runs: multisets, texts, decisions and replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiset_difference(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n): what ``before`` has more often than ``after``, and how much more; counts combine before they shuffle."""
    a = before.groupBy(*columns).agg(F.count("*").alias("_a"))
    b = after.groupBy(*columns).agg(F.count("*").alias("_b"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
    joined = a.alias("a").join(b.alias("b"), same, "left")
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in columns], (F.col("_a") - F.coalesce("_b", F.lit(0))).alias("n")).where("n > 0")


def text_changes(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """(key, before_length, after_length, at): works of both runs whose texts differ, nulls told apart, and where the first difference is.

    The place is found by halving: equal prefixes of powers of two come first, so no text is gone through character by character.
    """
    joined = before.select(key, F.col(text).alias("_a")).join(after.select(key, F.col(text).alias("_b")), key).where(~F.col("_a").eqNullSafe(F.col("_b")))
    length = F.least(F.length(F.coalesce("_a", F.lit(""))), F.length(F.coalesce("_b", F.lit(""))))
    bits = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    alike = lambda at, n: F.substring(F.col("_a"), at + 1, n) == F.substring(F.col("_b"), at + 1, n)
    at = F.aggregate(bits, F.lit(0), lambda acc, n: F.when((acc + n <= length) & alike(acc, n), acc + n).otherwise(acc))
    return joined.select(key, F.length("_a").alias("before_length"), F.length("_b").alias("after_length"), at.alias("at"))


def decision_changes(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): decisions that are new, gone or changed, values compared with nulls told apart."""
    a = before.select(*keys, F.struct(*values).alias("_a"))
    b = after.select(*keys, F.struct(*values).alias("_b"))
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, keys, "full").select(*keys, change.alias("change")).where("change is not null")


def present_in_all(rows: DataFrame, by: list[str], replicate: str, replicates: int, values: dict[str, Column]) -> DataFrame:
    """(by, values): averages over replicates of what every replicate has; ``values`` are aggregates by name."""
    found = rows.groupBy(*by).agg(F.countDistinct(replicate).alias("_k"), *[v.alias(n) for n, v in values.items()])
    return found.where(F.col("_k") == replicates).drop("_k")
