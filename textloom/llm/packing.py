"""Best-fit packing of tokenised documents into fixed-length sequences, planned over a length histogram.

The plan never sees a document: best-fit decreasing runs over at most ``capacity`` (length, count)
pairs and yields ranges of slots. Pieces then take slots by joining on their rank within their length. Each
task numbers the pieces of a length that it writes, and running sums over the tasks' counts make these numbers ranks, so no piece is
shuffled or sorted to be ranked, however common its length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import StreamingEncoder, Vocabulary, fast_merge
from .shared import bounded_batches, materialise

CAPACITY = 1024
END_ID = 2


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces, and their number among those of a length in a bucket.

    A bucket is what one task makes; bucket and number belong together only in a table that has been written.

    A text's ids are followed by ``END_ID``. Documents of more than ``capacity`` ids are cut so that all pieces but the
    first have ``capacity`` ids.
    """

    def run(batches):
        vocabulary = Vocabulary(tokenizer_path)
        encoder = StreamingEncoder(vocabulary, fast_merge(vocabulary))
        end = END_ID.to_bytes(4, "little")
        bucket, made = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = ([], [], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = b"".join(encoder.encode(text or "")) + end
                n, piece, start = len(ids) // 4, 0, 0
                stop = n % capacity or capacity
                while start < n:
                    size = stop - start
                    for out, value in zip(rows, (doc, piece, start, size, zlib.crc32(ids[4 * start : 4 * stop]), made[size])):
                        out.append(value)
                    made[size] += 1
                    piece, start, stop = piece + 1, stop, stop + capacity
            kinds = (batch.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "in_bucket", "bucket"]
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows, kinds), pa.array([bucket] * len(rows[0]), pa.int64())], names)

    kind = dict(documents.dtypes)["doc_id"]
    return bounded_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, in_bucket long, bucket long")


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first_rank, count, first_sequence, offset) ranges of slots.

    Open sequences with equal room form ranges of numbers. The longest lengths go first; each takes the ranges with the
    least room that fits. What a piece leaves of that room is again the least that fits while another piece fits in it, so
    a sequence takes ``room // length`` pieces before the next one. New sequences open for what is left.
    The sequences are as many as if best-fit decreasing placed piece after piece. A length adds at most two ranges,
    so the plan's size depends on ``capacity`` and not on the input.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free ids: ranges (first sequence, count)
    slots, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(first, count, free, deep):
            """``deep`` pieces into each of ``count`` sequences that have ``free`` ids left."""
            nonlocal left, rank
            for k in range(deep):
                slots.append((length, rank, count, first, capacity - free + k * length))
                rank += count
            left -= deep * count
            if free > deep * length:
                room[free - deep * length].append((first, count))

        for free in range(length, capacity):
            ranges = room.get(free)
            while left and ranges:
                first, count = ranges.pop()
                whole = min(count, left // (free // length))
                if whole:
                    fill(first, whole, free, free // length)
                if whole < count:
                    if left:  # fewer than fit in one
                        fill(first + whole, 1, free, left)
                        whole += 1
                    if whole < count:
                        ranges.append((first + whole, count - whole))
        each = capacity // length
        if count := left // each:
            fill(opened, count, capacity, each)
            opened += count
        if left:
            fill(opened, 1, capacity, left)
            opened += 1
    return slots


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and offset.

    A null or empty text is the one id ``END_ID``; a very long one is cut into pieces. Repeated rows are packed once each, and ties
    between pieces of a length go to the order in which they are written. A null doc_id is packed like any. An empty table gives
    no rows. Other columns of ``documents`` take no part, whatever their names.
    """
    pieces = materialise(token_pieces(documents, tokenizer_path, capacity), "pieces")
    spark = documents.sparkSession
    # at most ``capacity`` rows for each bucket; their running sums give each bucket its first rank
    counts = materialise(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = spark.createDataFrame(plan_slots(by_length, capacity), "of_length long, first_rank long, count long, first_sequence long, offset long")
    starts = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("bucket_start"))
    ranked = pieces.join(starts, ["length", "bucket"]).withColumn("rank", F.col("bucket_start") + F.col("in_bucket"))
    # fewer ranges than pairs of a length and a room: a bound that the capacity sets
    mine = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("count"))
    sequence = (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id")
    return ranked.join(F.broadcast(slots), mine).select("doc_id", "piece", "start", "length", "ids_crc32", sequence, "offset")
