"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

One task learns from a bounded sample of labelled rows (``max_rows``, a parameter) with a
learning rate for each coordinate; the L1 term leaves few weights, and they are the only thing that is
sent to the executors. Scoring is a narrow map over all rows, without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches
from .words import MULTIPLIER, WordHashes, mixed

BITS = 22
MAX_ROWS = 10_000
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")


def feature_indices(text: str | None, memo: WordHashes) -> np.ndarray:
    """Indices of all unigrams, bigrams and skip-grams of a text (with repeats), below ``2**BITS``."""
    h = memo.of(_WORD.findall((text or "").lower()))
    parts = [mixed(h)]
    for gap in (1, 2):
        if len(h) > gap:
            parts.append(mixed(h[:-gap] * MULTIPLIER + h[gap:] + np.uint64(gap)))
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.uint32)


def learn(
    rows: list[tuple[np.ndarray, int]],
    epochs: int = 6,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 25.0,
    l2: float = 0.01,
) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over rows of distinct feature indices: (indices, weights, bias).

    Gradients of toxic rows count as often more as there are fewer of them, up to 20 times.
    """
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = bias_n = 0.0
    toxic = sum(label for _, label in rows)
    heavier = min(20.0, max(1.0, (len(rows) - toxic) / max(toxic, 1)))

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0.0
        return w

    for _ in range(epochs):
        for i, label in rows:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = (p - label) * (heavier if label else 1.0)
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    at = np.flatnonzero(np.abs(z) > l1)
    return at.astype(np.uint32), weights(at).astype(np.float32), bias


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from at most ``max_rows`` labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    Which rows: those with the least hash of doc_id. A doc_id labelled both ways counts as toxic;
    rows with a null label or doc_id are left out. Without rows the model is empty and every score is 0.5.
    """
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # at most max_rows pairs of numbers are broadcast
    rows = bounded_batches(documents).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(1)

    def train(batches):
        memo, seen = WordHashes(), {}
        for batch in batches:
            for doc, text, label in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "toxic_label"))):
                if doc not in seen or (text or "") < seen[doc][2]:  # of rows that repeat an id, the least text counts
                    seen[doc] = (np.unique(feature_indices(text, memo)), int(label > 0), text or "")
        at, w, bias = learn([seen[k][:2] for k in sorted(seen, key=lambda k: mixed(np.array([k], np.int64).view(np.uint64))[0])])
        yield pa.RecordBatch.from_pydict({"at": [at.tobytes()], "w": [w.tobytes()], "bias": [bias]})

    got = rows.mapInArrow(train, "at binary, w binary, bias double").collect()
    if not got:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.0
    return np.frombuffer(got[0].at, np.uint32), np.frombuffer(got[0].w, np.float32), got[0].bias


def _scores(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], clean_only: bool) -> DataFrame:
    """``documents`` with a score in 0..1, all rows or those below the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most 2**22 weights

    def run(batches):
        at, w, bias = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w
        has, memo = dense != 0, WordHashes()
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column("text").to_pylist()):
                i = feature_indices(text, memo)
                out[k] = dense[np.unique(i[has[i]])].sum(dtype=np.float64) + bias
            p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            if clean_only:
                yield batch.filter(pa.array(p < THRESHOLD))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    if clean_only:
        return bounded_batches(documents).mapInArrow(run, documents.schema)
    return bounded_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, score double")


def keep_clean(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """The rows with a score below the threshold, with all their columns."""
    return _scores(documents, model, True)


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score in 0..1 and predicted (score >= 0.7) for every row.

    A null or empty text has no features, so its score is that of the bias. A null doc_id stays
    null and is not held out. Rows are independent: repeated rows give repeated results.
    """
    return _scores(documents, model, False).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )


def classify_toxicity(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``fit`` and ``score``, whose rules hold: every row is scored, whole texts of any length, an empty table gives no rows.

    Columns other than doc_id and text take no part, whatever their names; ties at the limit of labelled rows go by the hash of the doc_id.
    """
    return score(documents, fit(documents, labels, max_rows))
