"""Leaders compared with their members: each leader's payload once, its members' streaming past it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_salted, materialise

#: Members of a leader that one task compares.
MANY = 256


def met(edges: DataFrame, payload: DataFrame, judge, label: str) -> DataFrame:
    """(u, v) of ``edges`` where ``judge(payload of u, payload of v)``: each u's payload comes first, then its v's stream past it.

    A u with more than ``MANY`` is cut into as many groups as it takes, each with a copy of its payload.
    """
    edges = edges.groupBy("u", "v").agg(F.lit(1).alias("_one")).drop("_one")
    crowded = edges.groupBy("u").agg(F.ceil(F.count("*") / MANY).alias("groups")).where("groups > 1")
    dealt = join_salted(edges.withColumn("_spread", F.xxhash64("v")), crowded, ["u"], "_spread", "left")
    dealt = materialise(dealt.select("u", "v", F.coalesce(F.pmod(F.xxhash64("v", F.lit(7)), F.col("groups")), F.lit(0)).alias("part")), label)
    names = [c for c in payload.columns if c != "node"]
    heads = dealt.select("u", "part").distinct().join(payload.withColumnRenamed("node", "u"), "u").select("u", "part", F.lit(None).cast("long").alias("v"), *names)
    tails = dealt.join(payload.withColumnRenamed("node", "v"), "v").select("u", "part", "v", *names)

    def run(batches):
        key, head, ready = None, None, judge()
        for batch in batches:
            out = ([], [])
            for row in batch.to_pylist():
                now = (row["u"], row["part"])
                if row["v"] is None:
                    key, head = now, ready(row)
                elif now == key and ready(head, row):
                    out[0].append(row["u"])
                    out[1].append(row["v"])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["u", "v"])

    return heads.unionByName(tails).repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first()).mapInArrow(run, "u long, v long")


