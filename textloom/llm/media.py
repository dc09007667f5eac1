"""Media columns: payloads kept as MPEG audio in a binary column, and what parsing the column gives."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .mpeg import parse, payload_of, store
from .shared import bounded_batches, new_table_path

UNIT = 64


def store_texts(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text in UTF-8, padded with zero bytes to a positive multiple of 64, as MPEG audio.

    A null text is the empty text.
    """

    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode("utf-8")
                sizes.append(len(raw))
                media.append(store(raw + bytes(-len(raw) % UNIT if raw else UNIT)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return bounded_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes long, media binary")


def parse_media(stored: DataFrame) -> DataFrame:
    """The digests and features of a table with doc_id, n_bytes and media.

    ``media`` may be any MPEG audio: streams of other writers have null payload columns. A null is the empty stream, without frames.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "seek_offsets"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]

    def run(batches):
        for batch in batches:
            columns = [[] for _ in names]
            for media in batch.column("media").to_pylist():
                stream = parse(media or b"")
                payload = payload_of(stream)
                digests = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]))
                last = stream.offsets[-1] if stream.offsets else ""
                feature = f"frames={stream.frames};samples={stream.samples.total()};rate={stream.rate};crc={stream.checked_crc - stream.bad_crc}/{stream.checked_crc};seeks={len(stream.offsets)};last={last};toc={zlib.crc32(stream.toc)}"
                row = (*digests, len(media or b""), hashlib.sha256(media or b"").hexdigest(), feature, stream.seconds, stream.offsets)
                for out, value in zip(columns, row):
                    out.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *map(pa.array, columns, kinds)], ["doc_id", "n_bytes", *names])

    kind = dict(stored.dtypes)["doc_id"]
    return bounded_batches(stored).select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, seek_offsets array<long>")


def media_columns(documents: DataFrame) -> DataFrame:
    """Store every text, write the column to the shared folder, read it back and parse it.

    A null text is the empty one, a very long one is one stream. Equal texts give equal values, so repeated rows do; there are no ties.
    A null doc_id stays null. An empty table gives no rows, and other columns take no part.
    """
    stored = store_texts(documents)
    path = new_table_path(documents.sparkSession, "media")
    stored.write.option("compression", "zstd").parquet(path)
    return parse_media(documents.sparkSession.read.schema(stored.schema).parquet(path))
