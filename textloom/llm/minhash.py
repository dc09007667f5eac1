"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

1. A text becomes the set of its hashed word shingles; texts of equal sets are one class. One hash of each shingle deals it to one of
   252 bins, and a bin's value is the least hash in it. An empty bin takes the value of the first bin that has one, in an order of bins which
   hashing gives to each bin (optimal densification).
2. Bands of 6 values put classes into buckets: 1-(1-0.8**6)**42 = 0.999997 of the pairs at the threshold share one.
3. In each bucket all are compared with one leader only: the class whose buckets are fullest, as the origin of a group of copies is. Edges
   that sketches (small sets by their shingles, others by signatures) rule out go; the rest are confirmed on the full sets, streaming past the leader's, and give components.
4. Buckets that one component fills are settled. In the others, pairs of different components are judged by sketches, block against
   block, and for each two components the best of them are confirmed; then again with more, until none is left untried. So every pair of
   a bucket is confirmed, ruled out by its sketches, or within one component already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .jaccard import NEEDED, set_key
from .meet import met
from .shared import bounded_batches, join_salted, materialise
from .words import WordHashes, mixed, windows

SHINGLE = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
BANDS, ROWS = 42, 6
BINS = BANDS * ROWS
#: Up to this size a set is compared by 32 bits of each shingle; from ``LEAST_SIGNED`` on, which fills bins well, by its signature as well. A set
#: above the first bound meets none below the second.
MOST_FULL, LEAST_SIGNED = 400, 320
#: Members of a block of a bucket; copies from which a class is joined apart.
BLOCK, HOT_COPIES = 2048, 1000
#: Pairs of two components that are confirmed in the first round; later rounds take as many times more.
FIRST_PAIRS = 64


class ByteHashes(WordHashes):
    """The memo for words given as bytes."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


def shingle_set(text: str | None, memo: ByteHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles. Bytes split at space and 9 to 13 and lower-case A-Z alone, which is the rule."""
    return np.unique(windows(memo.of((text or "").encode("utf-8", "surrogatepass").lower().split()), size))


class OnePermutation:
    """Signatures of sorted sets of 64-bit hashes."""

    WIDTH = 64

    def __init__(self):
        self.orders = []

    def order(self, k: int) -> np.ndarray:
        """Places ``WIDTH * k`` and following of the order of bins of each bin."""
        while len(self.orders) <= k:
            start = len(self.orders) * self.WIDTH * BINS
            steps = mixed(np.arange(start, start + self.WIDTH * BINS, dtype=np.uint64) + np.uint64(0x51ED27))
            self.orders.append((steps % np.uint64(BINS)).astype(np.int64).reshape(self.WIDTH, BINS))
        return self.orders[k]

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """The 252 values of a set that isn't empty. A bin is a range of hashes, so its least hash is its first."""
        bins = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        values, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
        values[bins[first]], full[bins[first]] = mixed(shingles[first]), True
        empty, k = np.flatnonzero(~full), 0
        while len(empty):
            order = self.order(k)[:, empty]
            hits = full[order]
            found = hits.any(axis=0)
            at = hits.argmax(axis=0)
            values[empty[found]] = values[order[at[found], np.flatnonzero(found)]]
            empty, k = empty[~found], k + 1
        return values


def features(documents: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, (key_a, key_b) of the shingle set, its size, and, where it can link to another set, 16 bits of each value."""
    names = ["doc_id", "text_hash", "key_a", "key_b", "size", "signature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        memo, signer = ByteHashes(), OnePermutation()
        for batch in batches:
            columns = [[] for _ in range(4)]
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, memo)
                linkable = 100 * len(s) >= PERCENT * (len(s) + 1)
                row = (*set_key(s), len(s), signer.of(s).astype("<u2").tobytes() if linkable else None)
                for out, value in zip(columns, row):
                    out.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds[2:]))], names)

    rows = bounded_batches(documents).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, key_a long, key_b long, size long, signature binary")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, node, n): buckets with several classes, and their number."""
    width = 2 * ROWS
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("signature"), b * width + 1, F.lit(width))))
    rows = classes.where("signature is not null").select("node", F.explode(band).alias("bucket"))
    several = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return join_salted(rows.withColumn("_spread", F.xxhash64("node")), several, ["bucket"], "_spread", salts=8).select("bucket", "node", "n")


def stars(shared: DataFrame) -> DataFrame:
    """(u, v): every member v of a bucket with the bucket's leader u."""
    crowd = shared.groupBy("node").agg(F.sum("n").alias("crowd"))
    leaders = shared.join(crowd, "node").groupBy("bucket").agg(F.max(F.struct("crowd", (-F.col("node")).alias("less"))).alias("_most"))
    leaders = leaders.select("bucket", (-F.col("_most.less")).alias("u"))
    return join_salted(shared.select("bucket", F.col("node").alias("v"), F.xxhash64("node").alias("_spread")), leaders, ["bucket"], "_spread", salts=8).where("u <> v").select("u", "v").distinct()


def possible(size_a: int, size_b: int) -> bool:
    return 100 * min(size_a, size_b) >= PERCENT * max(size_a, size_b)


def sketched(rows: DataFrame) -> DataFrame:
    """``rows`` (node, size, text) with full, 32 bits of each shingle of a small set, and signature, of a set that isn't small."""

    def run(batches):
        memo, signer = ByteHashes(), OnePermutation()
        for batch in batches:
            full, signatures = [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, memo)
                full.append((s >> np.uint64(32)).astype("<u4").tobytes() if len(s) <= MOST_FULL else None)
                signatures.append(signer.of(s).astype("<u2").tobytes() if len(s) >= LEAST_SIGNED else None)
            yield batch.append_column("full", pa.array(full, pa.binary())).append_column("signature", pa.array(signatures, pa.binary()))

    return bounded_batches(rows).select("node", "size", "text").mapInArrow(run, "node long, size long, text string, full binary, signature binary")


def near_enough(both, size_a, size_b):
    """Whether sets with ``both`` shingles in common may be linked; two more, as 32 bits may coincide within a set."""
    return 100 * (both + 2) >= PERCENT * (size_a + size_b - both - 2)


def _by_sketch():
    needed = NEEDED[-1]

    def ready(head, row=None):
        if row is None:
            return head["size"], *(None if head[c] is None else np.frombuffer(head[c], t) for c, t in (("full", "<u4"), ("signature", "<u2")))
        size, full, signature = head
        if not possible(size, row["size"]):
            return False
        if full is not None and row["full"] is not None:
            return bool(near_enough(len(np.intersect1d(full, np.frombuffer(row["full"], "<u4"))), size, row["size"]))
        return int((signature == np.frombuffer(row["signature"], "<u2")).sum()) >= needed

    return ready


def _by_sets():
    memo = ByteHashes()

    def ready(head, row=None):
        if row is None:
            return shingle_set(head["text"], memo)
        other = shingle_set(row["text"], memo)
        both = len(np.intersect1d(head, other, assume_unique=True))
        return 100 * both >= PERCENT * (len(head) + len(other) - both)

    return ready


def _suspects(rows: list[dict], needed: int):
    """Pairs (i, j, agreement) of ``rows``, of different components, that sketches don't rule out; of two blocks, or within the one."""
    n = len(rows)
    sizes, roots, block = (np.array([r[c] for r in rows]) for c in ("size", "root", "block"))
    within = rows[0]["first"] == rows[0]["second"]
    small, signed = sizes <= MOST_FULL, sizes >= LEAST_SIGNED
    signatures = np.zeros((n, BINS), "<u2")
    for k in np.flatnonzero(signed):
        signatures[k] = np.frombuffer(rows[k]["signature"], "<u2")
    # postings of the small sets: who has a shingle
    owners = np.flatnonzero(small)
    full = [np.frombuffer(rows[k]["full"], "<u4") for k in owners]
    lengths = [len(f) for f in full]
    _, ids = np.unique(np.concatenate([*full, np.zeros(0, "<u4")]), return_inverse=True)
    starts, begins = np.r_[0, np.cumsum(np.bincount(ids))], dict(zip(owners.tolist(), np.r_[0, np.cumsum(lengths)].tolist()))
    postings = np.repeat(owners, lengths)[np.argsort(ids, kind="stable")]
    for i in range(n - 1):
        js = np.arange(i + 1, n)
        js = js[(roots[js] != roots[i]) & (100 * np.minimum(sizes[js], sizes[i]) >= PERCENT * np.maximum(sizes[js], sizes[i]))]
        if not within:
            js = js[block[js] != block[i]]
        by_set = js[small[js]] if small[i] else js[:0]
        if len(by_set):
            mine = ids[begins[i] : begins[i] + len(np.frombuffer(rows[i]["full"], "<u4"))]
            counts = starts[mine + 1] - starts[mine]
            flat = np.repeat(starts[mine] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
            both = np.bincount(postings[flat], minlength=n)[by_set]
            keep = near_enough(both, sizes[i], sizes[by_set])
            by_set, both = by_set[keep], both[keep]
            if len(by_set):
                yield i, by_set, both / (sizes[i] + sizes[by_set] - both)
        others = js[~small[js]] if small[i] else js
        if len(others):
            matches = (signatures[others] == signatures[i]).sum(axis=1)
            keep = matches >= needed
            if keep.any():
                yield i, others[keep], matches[keep] / BINS


def _best_pairs(skipped: int, most: int):
    """For each two components in a block or two blocks of a bucket the pairs whose sketches agree best, from place ``skipped`` to ``most``; ``more``: others follow."""
    needed = NEEDED[-1]

    def judge(rows):
        rows = sorted({r["node"]: r for r in rows}.values(), key=lambda r: r["node"])
        found = [(np.full(len(js), i, np.int32), js.astype(np.int32), agreement.astype(np.float32)) for i, js, agreement in _suspects(rows, needed)]
        if not found:
            return
        i, j, agreement = (np.concatenate(x) for x in zip(*found))
        codes = np.unique(np.array([r["root"] for r in rows]), return_inverse=True)[1]
        pair = np.minimum(codes[i], codes[j]) * len(rows) + np.maximum(codes[i], codes[j])
        order = np.lexsort((j, i, -agreement, pair))
        pair = pair[order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        lengths = np.diff(np.r_[first, len(pair)])
        place = np.arange(len(pair)) - np.repeat(first, lengths)
        chosen = (place >= skipped) & (place < most)
        nodes = np.array([r["node"] for r in rows])
        at = order[chosen]
        yield nodes[i[at]], nodes[j[at]], (np.repeat(lengths, lengths) > most)[chosen]

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["bucket"], row["first"], row["second"])
                if now != key and len(rows) > 1:
                    yield from map(_pairs, judge(rows))
                if now != key:
                    key, rows = now, []
                rows.append(row)
        if len(rows) > 1:
            yield from map(_pairs, judge(rows))

    def _pairs(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.bool_()))], ["u", "v", "more"])

    return run


def _unsettled(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, n, root) of the buckets with several components; of buckets with the same members one."""
    placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mark = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"mark_{k}") for k in (1, 2)]
    split = placed.groupBy("bucket").agg(F.min("root").alias("_least"), F.max("root").alias("_most"), F.count("*").alias("_n"), *mark).where("_least <> _most")
    once = split.groupBy("mark_1", "mark_2", "_n").agg(F.min("bucket").alias("bucket")).select("bucket")
    return join_salted(placed.withColumn("_spread", F.xxhash64("node")), once, ["bucket"], "_spread", salts=8)


def _pair_blocks(open_rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with the pairs of blocks (first, second) of their bucket that they take part in."""
    parts = F.ceil(F.col("n") / BLOCK)
    rows = open_rows.withColumn("block", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.select("bucket", "node", "root", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    return rows.join(known, "node").repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")


def link_forest(classes: DataFrame, documents: DataFrame, most_rounds: int = 30) -> DataFrame:
    """(node, root): components of the links between ``classes`` (node, rep, text_hash, size, signature)."""
    shared = materialise(shared_buckets(classes), "buckets")
    known = classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "rep", "text_hash", "size")
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("text_hash"), "text")
    known = materialise(sketched(known.join(texts, ["rep", "text_hash"])), "bucketed")
    texts, sketches = known.select("node", "text"), known.drop("text")
    tried = materialise(met(stars(shared), sketches, _by_sketch, "stars"), "likely")
    links = materialise(met(tried, texts, _by_sets, "likely-dealt"), "links")
    roots = materialise(components(links, "linked").distinct(), "roots")
    skipped, most = 0, FIRST_PAIRS
    for _ in range(most_rounds):
        best = materialise(_pair_blocks(_unsettled(shared, roots), sketches).mapInArrow(_best_pairs(skipped, most), "u long, v long, more boolean"), "best")
        new = best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        new = materialise(new.join(tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti"), "new")
        confirmed = materialise(met(new, texts, _by_sets, "new-dealt"), "links")
        merged = not confirmed.isEmpty()
        if merged:
            links = materialise(links.unionByName(confirmed), "all-links")
            roots = materialise(components(links, "linked").distinct(), "roots")
        if best.where("more").isEmpty():  # whatever sketches left is confirmed or not; merging only takes pairs away
            return roots
        tried = materialise(tried.unionByName(new), "tried")
        # where nothing merged, the places of pairs are as before
        skipped, most = 0 if merged else most, most * FIRST_PAIRS
    raise RuntimeError("pairs are left untried")


def minhash_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    component_id: the least doc_id that links reach; linked are texts whose sets of four-word shingles have 0.8 or more of their union in
    common. kept: whether that is the document itself.

    A text of fewer words is one shingle. A text without words, or null, has the empty set and is linked with nothing; long texts count
    whole. Rows that repeat a text are linked, also under one doc_id; rows of one doc_id with other texts are linked as their texts are. The
    least doc_id decides ties. A row without doc_id takes part in nothing: its component is null, and it is kept. An empty table gives no
    rows; columns beside doc_id and text take no part.
    """
    found = materialise(features(documents), "one-permutation")
    sets = found.where("doc_id is not null and size > 0")
    classes = sets.groupBy("key_a", "key_b").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("_rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature")
    )
    classes = classes.select("key_a", "key_b", F.col("_rep.doc_id").alias("rep"), F.col("_rep.text_hash").alias("text_hash"), "copies", "size", "signature")
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    linked = link_forest(classes, documents).join(classes.select("node", "rep"), "node")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "root").select("node", "least")
    named = classes.select("key_a", "key_b", "rep", "copies", "node").join(linked, "node", "left")
    named = materialise(named.select("key_a", "key_b", "copies", F.coalesce("least", "rep").alias("component_id")), "named")
    rows = found.select("doc_id", F.col("size").alias("n_shingles"), "key_a", "key_b")
    # classes of very many copies are few, and are joined apart, salted: no task gets one whole
    hot = join_salted(rows.withColumn("_spread", F.xxhash64("doc_id")), named.where(F.col("copies") > HOT_COPIES).drop("copies"), ["key_a", "key_b"], "_spread", "left")
    usual = hot.where("component_id is null and doc_id is not null and n_shingles > 0").drop("component_id").join(named.where(F.col("copies") <= HOT_COPIES).drop("copies"), ["key_a", "key_b"], "left")
    rest = hot.where("component_id is not null or doc_id is null or n_shingles = 0")
    out = rest.unionByName(usual).withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
