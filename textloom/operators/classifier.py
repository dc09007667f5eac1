"""Logistic regression in folds: all folds fitted in one pass a step, predictions for each row by the fold that didn't see it, and their AUC."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise

#: Numbers of a row at most, with folds: their weights travel to the tasks and their Hessians to the driver.
MOST_DIMENSIONS, MOST_FOLDS = 1024, 20
CELLS = 4096


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))


def fit_folds(rows: DataFrame, folds: int, penalty: float = 1.0, steps: int = 25, tolerance: float = 1e-10) -> np.ndarray:
    """Weights, the bias last, of each fold's model: of all rows outside the fold, by Newton steps on the penalised likelihood.

    ``rows``: fold, x (an array of doubles), y (0 or 1). In a step each task adds up the gradients and Hessians of all folds over its rows; their sums
    by fold come to the driver, whose size the bounds of dimensions and folds limit. The bias isn't penalised.
    """
    first = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    d = first["most"] or 0
    if first["least"] != first["most"] or d > MOST_DIMENSIONS or folds > MOST_FOLDS:
        raise ValueError("rows need equally many numbers, within the bounds of dimensions and folds")
    weights = np.zeros((folds, d + 1))

    def sums(weights):
        def run(batches):
            gradient, hessian = np.zeros((folds, d + 1)), np.zeros((folds, d + 1, d + 1))
            for batch in batches:
                if not batch.num_rows:
                    continue
                fold, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
                x = np.c_[_matrix(batch.column(1)), np.ones(batch.num_rows)]
                for f in range(folds):
                    other = fold != f
                    p = _probability(x[other, :-1], weights[f])
                    gradient[f] += (y[other] - p) @ x[other]
                    hessian[f] += (x[other] * (p * (1 - p))[:, None]).T @ x[other]
            yield pa.RecordBatch.from_arrays([pa.array(range(folds), pa.int32()), pa.array([g.tobytes() for g in gradient], pa.binary()), pa.array([h.tobytes() for h in hessian], pa.binary())], ["fold", "gradient", "hessian"])

        return run

    def total(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                parts = [np.frombuffer(r[c]) for c in ("gradient", "hessian")]
                held[r["fold"]] = [a + b for a, b in zip(held[r["fold"]], parts)] if r["fold"] in held else parts
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *(pa.array([h[k].tobytes() for h in held.values()], pa.binary()) for k in (0, 1))], ["fold", "gradient", "hessian"])

    schema = "fold int, gradient binary, hessian binary"
    for _ in range(steps):
        added = rows.select("fold", "x", "y").mapInArrow(sums(weights), schema).repartition("fold").mapInArrow(total, schema)
        moved = 0.0
        for r in added.collect():  # one for each fold
            ridge = np.diag(np.r_[np.full(d, penalty), 0.0])
            gradient, hessian = np.frombuffer(r.gradient), np.frombuffer(r.hessian).reshape(d + 1, d + 1)
            step = np.linalg.solve(hessian + ridge + 1e-12 * np.eye(d + 1), gradient - ridge @ weights[r.fold])
            weights[r.fold] += step
            moved = max(moved, np.abs(step).max())
        if moved < tolerance:
            break
    return weights


def out_of_fold(rows: DataFrame, key: str, x: str, y: str, folds: int = 5, penalty: float = 1.0) -> DataFrame:
    """(key, fold, y, p): the probability of label 1 that the model fitted without a row's fold gives it. The fold is a hash of the key.

    Rows with a null in key, numbers or label take no part; rows that repeat a key are in one fold. A fold whose other rows have one label gives that label's
    rate. An empty table gives no rows.
    """
    known = rows.select(F.col(key).alias("key"), F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("fold"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("int").alias("y"))
    known = materialise(known.where("key is not null and x is not null and y is not null and not exists(x, v -> v is null or isnan(v))"), "labelled")
    kind = dict(rows.dtypes)[key]
    if known.isEmpty():
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, fold int, y int, p double")
    weights = fit_folds(known, folds, penalty)

    def run(batches):
        for batch in batches:
            fold, m = batch.column("fold").to_numpy(zero_copy_only=False), _matrix(batch.column("x"))
            p = np.zeros(batch.num_rows)
            for f in np.unique(fold):
                p[fold == f] = _probability(m[fold == f], weights[f])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("fold"), batch.column("y"), pa.array(p)], ["key", "fold", "y", "p"])

    return known.mapInArrow(run, f"key {kind}, fold int, y int, p double").withColumnRenamed("key", key)


def auc(scored: DataFrame, by: list[str], score: str = "p", label: str = "y") -> DataFrame:
    """(by, n, positives, auc): the chance that a row of label 1 scores higher than one of label 0, ties being half; null where a label is missing.

    Scores are cut into cells of equal width between 0 and 1; counts of cells tell how many lie below, and each cell is ordered on its own.
    """
    counts = scored.groupBy(*by, score).agg(F.sum(F.col(label)).alias("_pos"), F.sum(1 - F.col(label)).alias("_neg"))
    counts = counts.withColumn("_cell", F.least(F.floor(F.col(score) * CELLS), F.lit(CELLS - 1)))
    cells = counts.groupBy(*by, "_cell").agg(F.sum("_neg").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # one row for each cell
    starts = cells.select(*by, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*by, "_cell").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_within", F.coalesce(F.sum("_neg").over(within), F.lit(0))).join(starts, [*by, "_cell"])
    wins = F.sum(F.col("_pos") * (F.col("_start") + F.col("_within") + F.col("_neg") / 2))
    out = placed.groupBy(*by).agg(F.sum(F.col("_pos") + F.col("_neg")).alias("n"), F.sum("_pos").alias("positives"), wins.alias("_wins"))
    return out.select(*by, "n", "positives", F.try_divide("_wins", F.col("positives") * (F.col("n") - F.col("positives"))).alias("auc"))


def doubtful(scored: DataFrame, least: float) -> DataFrame:
    """Rows whose label the model of the other folds gives less than ``1 - least``, with their ``doubt``, for a second look."""
    doubt = F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p"))
    return scored.withColumn("doubt", doubt).where(F.col("doubt") > least)
