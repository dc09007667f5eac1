"""Exact quantiles of groups of any size, by counts of buckets that are refined until little is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise

#: Buckets of a round; distinct values up to which the last one is sorted.
BUCKETS, FEW = 1024, 4096


def quantiles(rows: DataFrame, group: list[str], value: str, wanted: list[float], most_rounds: int = 40) -> DataFrame:
    """(group, q, value): the quantiles ``wanted`` of each group, interpolated between neighbours as ``percentile`` does.

    A quantile lies at one or two ranks of its group. Each round cuts the range that a rank is known to lie in into buckets and counts them; the one that
    holds the rank is the next range, and how many values lie below is kept. Where a range has few distinct values, their counts decide. So a task
    holds the buckets of a rank, never a group's values. Nulls and NaN take no part; a group of nothing else has no row. Infinite values are
    values like others.
    """
    known = rows.select(*[F.struct(F.col(g).alias("x")).alias(f"_g{k}") for k, g in enumerate(group)], F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    keys = [f"_g{k}" for k in range(len(group))]  # structs, so that null groups join
    known = materialise(known if keys else known.withColumn("_g", F.lit(0)), "quantile-values")
    keys = keys or ["_g"]
    sizes = known.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.col("q") * (F.col("n") - 1)
    asked = sizes.withColumn("q", F.explode(F.array(*map(F.lit, map(float, wanted))))).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    ranges = materialise(asked.select(*keys, "q", "n", "rank", "low", "high", F.lit(0).cast("long").alias("below")), "ranges")
    found = None
    for _ in range(most_rounds):
        within = known.join(ranges, keys).where("v between low and high")
        counted = materialise(within.groupBy(*keys, "q", "rank").agg(F.approx_count_distinct("v").alias("d")), "distinct")
        told = ranges.join(counted, [*keys, "q", "rank"])
        last = told.where(F.col("d") <= FEW).drop("d")
        order = Window.partitionBy(*keys, "q", "rank").orderBy("v")
        values = known.join(last, keys).where("v between low and high").groupBy(*keys, "q", "n", "rank", "below", "v").agg(F.count("*").alias("c"))
        values = values.withColumn("upto", F.col("below") + F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        done = values.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank"))).select(*keys, "q", "n", "rank", "v")
        found = materialise(done if found is None else found.union(done), "found")
        rest = told.where(F.col("d") > FEW).drop("d")
        if rest.isEmpty():
            break
        # the two halves of the range apart, so that its width never overflows
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        bucket = F.when(F.col("v") >= F.col("high"), BUCKETS - 1).when(F.col("low") == float("-inf"), F.when(F.col("v") > F.col("low"), BUCKETS - 1).otherwise(0)).otherwise(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)))
        buckets = known.join(rest, keys).where("v between low and high").groupBy(*keys, "q", "n", "rank", "below", bucket.alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        order = Window.partitionBy(*keys, "q", "rank").orderBy("b")
        buckets = buckets.withColumn("upto", F.col("below") + F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        kept = buckets.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        ranges = materialise(kept.select(*keys, "q", "n", "rank", "low", "high", (F.col("upto") - F.col("c")).alias("below")), "ranges")
    else:
        raise RuntimeError("quantiles did not settle")
    pair = found.groupBy(*keys, "q", "n").agg(F.min("v").alias("lower"), F.max("v").alias("upper"))
    part = F.col("q") * (F.col("n") - 1) - F.floor(F.col("q") * (F.col("n") - 1))
    between = F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(F.col("lower") * (1 - part) + F.col("upper") * part)
    return pair.select(*[F.col(f"_g{k}")["x"].alias(g) for k, g in enumerate(group)], "q", between.alias("value"))
