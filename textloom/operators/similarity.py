"""Distances between groups of vectors, by mean unit vectors instead of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, dot, mean_vectors, unit
from ..shared import bounded_batches


def group_distances(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """For every pair of groups a < b: the mean cosine distance across, within each, J (across minus the mean within), and that of the prototypes.

    Means of all pairs follow from each group's mean unit vector: n times the dimension, never the pairs.
    """
    means = mean_vectors(vectors.select(group, unit(F.col(vector)).alias("u")), [group], "u")
    square = dot(F.col("mean"), F.col("mean"))
    within = 1 - (F.col("n") * F.col("n") * square - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    stats = means.select(group, "n", "mean", F.when(F.col("n") > 1, within).alias("within"))
    a, b = (stats.select(*[F.col(c).alias(f"{c}_{s}") for c in (group, "n", "mean", "within")]) for s in "ab")
    across = 1 - dot(F.col("mean_a"), F.col("mean_b"))
    return (
        a.join(b, F.col(f"{group}_a") < F.col(f"{group}_b"))
        .withColumn("across", across)
        .select(f"{group}_a", f"{group}_b", "across", "within_a", "within_b", (F.col("across") - (F.col("within_a") + F.col("within_b")) / 2).alias("j"), cosine_distance(F.col("mean_a"), F.col("mean_b")).alias("prototype"))
    )


#: Rows of a block at most; rows of it, and rows that pass it, which meet in one product.
BLOCK, ASKED, PASSING = 32_768, 1024, 4096


def _top_rows(ours: tuple, theirs: tuple, best: list, k: int) -> list:
    """``best`` (row, similarity, other), sorted, the k nearest of each row of ``ours`` (keys, unit vectors), after ``theirs`` have passed."""
    import numpy as np

    (keys, a), (others, b), (row, near, other) = ours, theirs, best
    s = a @ b.T
    # a row that has k already needs more than its last; twelve digits count
    have, bar = np.bincount(row, minlength=len(a)), np.full(len(a), -np.inf)
    full = have == k
    bar[full] = near[np.cumsum(have)[full] - 1]
    r, c = np.nonzero(s >= bar[:, None] - 1e-11)
    if len(r) > 4 * k * len(a) and s.shape[1] > k:
        s[keys[:, None] == others] = -np.inf
        bar = np.maximum(bar, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        r, c = np.nonzero(s >= bar[:, None] - 1e-11)
    kept = keys[r] != others[c]
    r, c = r[kept], c[kept]
    row, near, other = np.r_[row, r], np.r_[near, np.round(s[r, c], 12)], np.concatenate([other, others[c]])
    order = np.lexsort((other, -near, row))
    row, near, other = row[order], near[order], other[order]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    return [x[place < k] for x in (row, near, other)]


def top_neighbours(vectors: DataFrame, key: str, vector: str, k: int, blocks: int | None = None) -> DataFrame:
    """(key, neighbours): the k nearest by cosine among all others, ties to the smaller key.

    One side is cut into blocks by hash; a task holds a block and lets all rows pass it, some thousand at a time, and keeps k for each of its rows.
    So rows are shuffled once for each block, and all pairs are made, but none is kept or sorted that can't be among the k.
    """
    import itertools

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if blocks is None:
        n = vectors.count()
        blocks = max(1, -(-n // BLOCK), min(2 * vectors.sparkSession.sparkContext.defaultParallelism, n // ASKED))
    kind = dict(vectors.dtypes)[key]
    known = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    left = known.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("i"), F.lit(0).alias("side"), "key", "v")
    right = known.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"), F.lit(1).alias("side"), "key", "v")

    def arrays(held):
        table = pa.Table.from_batches(held)
        m = pc.list_flatten(table["v"]).to_numpy().astype(float).reshape(len(table), -1)
        return np.array(table["key"].to_pylist()), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def sides(batches):
        """((i, side), rows) for stretches of equal block and side."""
        for batch in batches:
            marks = [batch[c].to_numpy() for c in ("i", "side")]
            cuts = np.flatnonzero(np.diff(2 * marks[0] + marks[1], prepend=-1)).tolist()
            for start, stop in zip(cuts, [*cuts[1:], len(batch)]):
                yield (int(marks[0][start]), int(marks[1][start])), batch.slice(start, stop - start)

    def run(batches):
        for _, group in itertools.groupby(sides(batches), key=lambda x: x[0][0]):
            ours, best = [], []
            for side, rows in itertools.groupby(group, key=lambda x: x[0][1]):
                if side == 0:
                    keys, m = arrays([b for _, b in rows])
                    ours = [(keys[x : x + ASKED], m[x : x + ASKED]) for x in range(0, len(keys), ASKED)]
                    best = [[np.zeros(0, int), np.zeros(0), keys[:0]] for _ in ours]
                    continue
                held, size = [], 0
                for _, b in rows if ours else ():
                    held.append(b)
                    size += len(b)
                    if size >= PASSING:
                        theirs, held, size = arrays(held), [], 0
                        best = [_top_rows(a, theirs, b, k) for a, b in zip(ours, best)]
                if held:
                    theirs = arrays(held)
                    best = [_top_rows(a, theirs, b, k) for a, b in zip(ours, best)]
            for (keys, _), (row, near, other) in zip(ours, best):
                yield pa.RecordBatch.from_arrays([pa.array(keys[row].tolist(), keyed), pa.array(other.tolist(), keyed), pa.array(near)], ["key", "other", "similarity"])

    keyed = known.limit(0).toArrow().schema.field("key").type
    dealt = bounded_batches(left.unionByName(right)).repartition(blocks, "i").sortWithinPartitions("i", "side")
    found = dealt.mapInArrow(run, f"key {kind}, other {kind}, similarity double").withColumnRenamed("key", key)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
