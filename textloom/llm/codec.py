"""BPE encoding and decoding of a text column by the streaming transducer of ``bpe``."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import StreamingDecoder, StreamingEncoder, Vocabulary, fast_merge
from .shared import bounded_batches


def encode_and_decode(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text, for every row.

    Ids leave the encoder in chunks and go on to the decoder and the digests, so no text's ids are held
    whole, and a very long text or an unbroken run in it takes no more memory than its row. A null or empty text has no tokens. Rows
    are independent of each other: repeated rows give repeated results, and there are no ties. An empty table gives no rows, and other
    columns take no part.
    """

    def run(batches):
        vocabulary = Vocabulary(tokenizer_path)
        encoder = StreamingEncoder(vocabulary, fast_merge(vocabulary))
        for batch in batches:
            rows = ([], [], [])
            for text in batch.column("text").to_pylist():
                ids, decoded, n, decoder = hashlib.sha256(), hashlib.sha256(), 0, StreamingDecoder(vocabulary)
                for chunk in encoder.encode(text or ""):
                    ids.update(chunk)
                    n += len(chunk) // 4
                    decoded.update(decoder.push(np.frombuffer(chunk, "<u4").tolist()).encode("utf-8"))
                decoded.update(decoder.end().encode("utf-8"))
                for out, value in zip(rows, (n, ids.hexdigest(), decoded.hexdigest())):
                    out.append(value)
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, rows, kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(documents.dtypes)["doc_id"]
    return bounded_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """``documents`` with one more column, ``token_ids``: a null text stays null, an empty one has no ids."""

    def run(batches):
        vocabulary = Vocabulary(tokenizer_path)
        encoder = StreamingEncoder(vocabulary, fast_merge(vocabulary))
        for batch in batches:
            ids = [None if t is None else np.frombuffer(b"".join(encoder.encode(t)), "<u4").astype("i4") for t in batch.column("text").to_pylist()]
            yield batch.append_column("token_ids", pa.array(ids, pa.list_(pa.int32())))

    from pyspark.sql import types as T

    return bounded_batches(documents).mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))
