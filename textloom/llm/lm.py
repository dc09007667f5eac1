"""Stupid-backoff scores from n-gram counts over all documents.

The tables are relations of packed columns. A task gathers documents into chunks of about ``CHUNK_TOKENS`` tokens, writes the
chunk's tokens to the shared folder, and explodes it into its distinct n-grams: sorted 64-bit keys with
counts, one row for each hash partition of the keys. Grouped by partition, these rows are the count table: all chunks'
counts of a key meet there, and each chunk gets back the totals of its keys. Joined by chunk to its tokens,
they give the score of every token, summed per document. A key that every document has is one entry for each chunk, so no key is heavy.

Single words and pairs are counted in a first round. From then on an n-gram with an (n-1)-gram in it that is seen once is itself
seen once, and it can be seen ``min_count`` times only if both (n-1)-grams in it are. So only n-grams whose both (n-1)-grams are
seen twice and ``min_count`` times are exploded in the next round; the counts of the others are known or do not count.

Score of a token after its context, for the longest context of up to ``order`` - 1 tokens in the document: with
n-grams seen fewer than ``min_count`` times counting as unseen, the longest seen n-gram gives
count(n-gram) / count(its context), times ``alpha`` for each step down; a single token gives count / total.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import open_bytes, write_whole
from .shared import bounded_batches, new_table_path
from .words import WordHashes, mixed, windows

ORDER = 3
MIN_COUNT = 1
ALPHA = 0.4
CHUNK_TOKENS = 2_000_000
#: Tokens for each hash partition of the keys: a task of counting holds the n-grams of about so many.
PART_TOKENS = 1_000_000
SCHEMA = "chunk long, part long, path string, payload binary"


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending distinct 64-bit keys as six-byte steps; as whole keys where a step is longer."""
    steps = np.diff(keys, prepend=np.uint64(0))
    if len(steps) > 1 and not (steps[1:] >> np.uint64(48)).any():
        return b"\1" + steps[:1].tobytes() + steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"\0" + keys.astype("<u8").tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, "<u8", offset=1)
    steps = np.zeros(((len(data) - 9) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    return np.cumsum(np.r_[np.frombuffer(data, "<u8", 1, 1), steps.reshape(-1).view("<u8")], dtype=np.uint64)


def pack_all(parts: list[bytes]) -> bytes:
    return b"".join([len(parts).to_bytes(4, "little"), *(len(p).to_bytes(8, "little") for p in parts), *parts])


def unpack_all(data: bytes) -> list[bytes]:
    n, at, out = int.from_bytes(data[:4], "little"), 0, []
    at = 4 + 8 * n
    for k in range(n):
        size = int.from_bytes(data[4 + 8 * k : 12 + 8 * k], "little")
        out.append(data[at : at + size])
        at += size
    return out


def squeezed(x: np.ndarray) -> bytes:
    """Counts or numbers: their four bytes, or eight where one is 2**32 or more, as planes, so that small ones cost little."""
    width = 8 if len(x) and x.max() >= 2**32 else 4
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(data[0], -1).T).reshape(-1).view(f"<u{data[0]}")


def _tokens(text: str | None) -> list[str]:
    """Lower-cased words between white space, as Python knows it."""
    return (text or "").lower().split()


def grams(hashes: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that end at each token, documents apart; only tokens with n-1 before them."""
    if n == 1:
        return mixed(hashes + np.uint64(1))
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    return windows(hashes, n)[_whole(lengths, n)]


def _position(lengths: np.ndarray) -> np.ndarray:
    """Each token's place in its document."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _whole(lengths: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n tokens lie within one document."""
    return _position(lengths)[n - 1 :] >= n - 1


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _rows(chunk: int, path: str, parts: int, orders: list[tuple[np.ndarray, np.ndarray]]):
    """One row for each hash partition: the sorted keys and the counts of every order in it."""
    packs: list[list[bytes]] = [[] for _ in range(parts)]
    for keys, counts in orders:
        cuts = np.searchsorted(_part(keys, parts), np.arange(parts + 1))
        for p in range(parts):
            own = slice(cuts[p], cuts[p + 1])
            packs[p] += (pack_sorted(keys[own]), squeezed(counts[own]))
    for p, pack in enumerate(packs):
        yield {"chunk": [chunk], "part": [p], "path": [path], "payload": [pack_all(pack)]}


def _batches(rows):
    for row in rows:
        yield pa.RecordBatch.from_pydict(row)


def _explode(documents: DataFrame, folder: str, parts: int, first: int, chunk_tokens: int) -> DataFrame:
    """Writes chunks of tokens, and explodes each into its n-grams of up to ``first`` tokens."""

    def run(batches):
        from pyspark import TaskContext

        memo = WordHashes()
        number, docs, arrays, held = TaskContext.get().partitionId() << 32, [], [], 0

        def chunk():
            lengths = np.array([len(a) for a in arrays], np.int64)
            hashes = np.concatenate([*arrays, np.zeros(0, np.uint64)])
            arrays.clear()
            words, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
            by_use = np.argsort(-times, kind="stable")
            number_of = np.empty(len(words), np.int64)
            number_of[by_use] = np.arange(len(words))
            content = [np.array([d or 0 for d in docs], "<i8").tobytes(), bytes(d is None for d in docs), lengths.astype("<i8").tobytes(), words[by_use].astype("<u8").tobytes(), squeezed(number_of[at])]
            del at, number_of, by_use, times
            path = f"{folder}/{uuid.uuid4().hex}"
            write_whole(path, [pack_all(content)])
            yield from _batches(_rows(number, path, parts, [np.unique(grams(hashes, lengths, n), return_counts=True) for n in range(1, first + 1)]))

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                docs.append(doc)
                arrays.append(memo.of(_tokens(text)))
                held += len(arrays[-1])
                if held >= chunk_tokens:
                    yield from chunk()
                    number, docs, arrays, held = number + 1, [], [], 0
        if docs:
            yield from chunk()

    return bounded_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def _sum_counts(exploded: DataFrame, parts: int) -> DataFrame:
    """Adds up each partition's counts over all chunks; every chunk's n-grams become their totals."""

    def run(batches):
        part, rows = None, []

        def answer():
            packs = [unpack_all(payload) for _, _, payload in rows]
            replies: list[list[bytes]] = [[] for _ in rows]
            for n in range(len(packs[0]) // 2):
                keys = [unpack_sorted(p[2 * n]) for p in packs]
                every, at = np.unique(np.concatenate(keys), return_inverse=True)
                totals = np.bincount(at, np.concatenate([unsqueezed(p[2 * n + 1]) for p in packs]), len(every))
                start = 0
                for reply, k in zip(replies, keys):
                    reply.append(squeezed(totals[at[start : start + len(k)]]))
                    start += len(k)
            yield from _batches({"chunk": [chunk], "part": [part], "path": [path], "payload": [pack_all(reply)]} for (chunk, path, _), reply in zip(rows, replies))

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if rows:
                        yield from answer()
                    part, rows = row["part"], []
                rows.append((row["chunk"], row["path"], row["payload"]))
        if rows:
            yield from answer()

    return exploded.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(run, SCHEMA)


def _read(path: str) -> list[bytes]:
    with open_bytes(path) as f:
        return unpack_all(f.read())


class Chunk:
    """A chunk's tokens, and the counts of the n-grams that end at each."""

    def __init__(self, path: str, min_count: int):
        files = [_read(p) for p in path.split("\n")]
        ids, self.missing, lengths, words, numbers = files[0]
        self.ids, self.lengths = np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8")
        self.hashes = np.frombuffer(words, "<u8")[unsqueezed(numbers)] if self.lengths.sum() else np.zeros(0, np.uint64)
        self.place, self.min_count, self.counts = _position(self.lengths), min_count, []
        for known in files[1:]:
            for part in known:
                self.add(unsqueezed(part))

    def possible(self, n: int) -> np.ndarray:
        """Tokens at which an n-gram ends whose count is to be found."""
        out = self.place >= n - 1
        if n > 2:
            often = self.counts[n - 2] >= max(2, self.min_count)
            out &= often & np.r_[False, often[:-1]]
        return out

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the possible n-grams the keys, and where they end."""
        ends = self.possible(n)
        if n == 1:
            return grams(self.hashes, self.lengths, 1), ends
        all_ends = self.place >= n - 1
        return grams(self.hashes, self.lengths, n)[ends[all_ends]], ends

    def add(self, known: np.ndarray) -> None:
        """The next order's totals, one for each sorted distinct key."""
        keys, ends = self.keys(len(self.counts) + 1)
        # beyond the possible ones: seen once, as a part is, or fewer than min_count > 2 times, which is as good as never
        c = np.where(self.place >= len(self.counts), 1.0 if self.min_count <= 2 else 0.0, 0.0)
        if len(keys):
            c[ends] = known[np.unique(keys, return_inverse=True)[1]]
        self.counts.append(c)

    def scores(self, total: int, alpha: float) -> np.ndarray:
        """The natural logarithm of each token's score."""
        score = np.log(self.counts[0] / total)
        for n in range(2, len(self.counts) + 1):
            can = self.place >= n - 1
            seen = can & (self.counts[n - 1] >= self.min_count)
            score = np.where(can, score + np.log(alpha), score)
            context = np.r_[0.0, self.counts[n - 2][:-1]]  # it ends at the token before
            score[seen] = np.log(self.counts[n - 1][seen] / context[seen])
        return score


def _chunks(batches, min_count: int):
    """(chunk number, path, Chunk with this round's counts added, those counts) of rows sorted by chunk and part."""
    number, path, replies = None, None, []

    def done():
        chunk, parts = Chunk(path, min_count), [unpack_all(r) for r in replies]
        new = [np.concatenate([unsqueezed(p[k]) for p in parts]) for k in range(len(parts[0]))]
        for known in new:
            chunk.add(known)
        return number, path, chunk, new

    for batch in batches:
        for row in batch.to_pylist():
            if row["chunk"] != number:
                if replies:
                    yield done()
                number, path, replies = row["chunk"], row["path"], []
            replies.append(row["payload"])
    if replies:
        yield done()


def _count_tokens(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"tokens": [sum(len(_tokens(t)) for t in batch.column("text").to_pylist())]})


def score_documents(documents: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, log_score (the sum) and mean_log_score (null without tokens) for every row.

    Tokens are lower-cased and stand between white space. A null or empty text has none, and its sum is 0; a very long one is
    part of one chunk, whole. Every row counts, repeated rows too; a null doc_id stays null. There are no ties to break. An empty
    table gives no rows, and other columns take no part. With the default ``min_count`` every n-gram counts.
    """
    spark = documents.sparkSession
    folder = new_table_path(spark, "chunks")
    total = max(1, bounded_batches(documents).select("text").mapInArrow(_count_tokens, "tokens long").agg(F.sum("tokens")).first()[0] or 0)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_TOKENS))

    def next_order(n):
        def run(batches):
            for number, path, chunk, new in _chunks(batches, min_count):
                counts = f"{folder}/{uuid.uuid4().hex}"
                write_whole(counts, [pack_all([squeezed(c) for c in new])])
                keys, _ = chunk.keys(n)
                yield from _batches(_rows(number, f"{path}\n{counts}", parts, [np.unique(keys, return_counts=True)]))

        return run

    def score(batches):
        for _, _, chunk, _ in _chunks(batches, min_count):
            n = chunk.lengths
            sums = np.add.reduceat(np.r_[chunk.scores(total, alpha), 0.0], np.cumsum(n) - n) if len(n) else np.zeros(0)
            sums = np.where(n > 0, sums, 0.0)
            docs = [None if m else int(d) for d, m in zip(chunk.ids, chunk.missing)]
            means = [float(s / k) if k else None for s, k in zip(sums, n)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n), pa.array(sums), pa.array(means, pa.float64())], ["doc_id", "n_tokens", "log_score", "mean_log_score"])

    by_chunk = lambda df: df.repartition(parts, "chunk").sortWithinPartitions("chunk", "part")
    counted = by_chunk(_sum_counts(_explode(documents, folder, parts, min(order, 2), chunk_tokens), parts))
    for n in range(3, order + 1):
        counted = by_chunk(_sum_counts(counted.mapInArrow(next_order(n), SCHEMA), parts))
    return counted.mapInArrow(score, "doc_id long, n_tokens long, log_score double, mean_log_score double")
