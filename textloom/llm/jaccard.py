"""N-gram Jaccard join: MinHash bands, Bayesian pruning of candidates, exact verification.

1. Each text becomes its set of hashed word shingles; texts with equal sets form one class.
2. Bands over a 252-value MinHash signature put classes into buckets. A pair at the threshold 0.8
   shares a bucket with probability 1-(1-0.8**7)**36 = 0.9998.
3. Each class is linked to the least class of each of its buckets (never all pairs), and components of these
   stars hold every pair that shares a bucket.
4. Large components may be chains of chance buckets. Their members' signatures alone, without texts, are compared bucket by bucket, 28 values at a
   time; a pair whose posterior probability of reaching the threshold falls below ``tolerance`` is dropped. The components of the pairs that are left
   take the place of the large ones.
5. Of a component that is still large, the members within half a link's distance of a leader are all linked with each other, as the distance is a metric.
   They are counted; only pairs with others are compared.
6. Components, the large ones in blocks, get their texts: pairs are pruned in the same way, and for the rest the
   exact Jaccard similarity decides. A block returns a count of links and one forest edge for each class, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .meet import met
from .shared import bounded_batches, join_salted, materialise
from .words import WordHashes, shingle_set

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 36, 7
VALUES = BANDS * ROWS
STEP = 28
TOLERANCE = 1e-6
#: Classes of a block whose texts, or whose signatures alone, are compared with another block's in one task; copies from which a class is joined apart.
BLOCK = 512
PRUNE_BLOCK = 2048
HOT_COPIES = 1000

_generator = np.random.default_rng(20240229)
_A = _generator.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _generator.integers(0, 2**63, VALUES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each of the 252 minima."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[k : k + 1024, None] * _A + _B).min(axis=0), out=least)
    return ((least >> np.uint64(20)) & np.uint64(0xFFFF)).astype("<u2")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 28, 56, ... compared values: the fewest matches that keep a pair, under a uniform prior.

    With m matches of n the posterior of the similarity is Beta(m+1, n-m+1); a pair is kept while its
    probability of reaching ``threshold`` is at least ``tolerance``.
    """
    x = (np.arange(20_000) + 0.5) / 20_000
    above = x >= threshold
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(x) + (n - m) * np.log1p(-x)
            density = np.exp(logs - logs.max())
            if density[above].sum() / density.sum() >= tolerance:
                out.append(m)
                break
    return out


#: Made once, where the job is built: each task of a few rows would take longer to make them than to compare its rows.
NEEDED = least_matches()


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8")
    return int(a), int(b)


def shingle_features(documents: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, (key_a, key_b) of the shingle set, its size and its signature (null for an empty set)."""

    def run(batches):
        memo = WordHashes()
        for batch in batches:
            rows = ([], [], [], [])
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, SHINGLE, memo)
                for out, value in zip(rows, (*set_key(s), len(s), signature(s).tobytes() if len(s) else None)):
                    out.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *map(pa.array, rows, kinds)], ["doc_id", "text_hash", "key_a", "key_b", "size", "signature"])

    return bounded_batches(documents).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, key_a long, key_b long, size long, signature binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(node, bucket): a row for each band."""
    width = 2 * ROWS
    return classes.where("size > 0").select(
        F.col("node"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("signature"), b * width + 1, F.lit(width))))).alias("bucket"),
    )


def _bucket_edges(classes: DataFrame) -> DataFrame:
    buckets = _buckets(classes)
    first = buckets.groupBy("bucket").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    return buckets.join(first, "bucket").where("node <> v").select(F.col("node").alias("u"), "v")


def _large_roots(members: DataFrame) -> DataFrame:
    """(root, parts): of components with more than ``BLOCK`` members, into how many parts each size level is cut, by level and whether tight."""
    blocks = members.groupBy("root", _level().alias("level"), "tight").agg(F.count("*").alias("n"))
    parts = F.map_from_entries(F.collect_list(F.struct(_kind().alias("kind"), F.ceil(F.col("n") / BLOCK).cast("long").alias("parts"))))
    return blocks.groupBy("root").agg(F.sum("n").alias("n"), parts.alias("parts")).where(F.col("n") > BLOCK).drop("n")


def _kind(level=None, tight=None):
    """A number for size level and tightness."""
    level, tight = F.col("level") if level is None else level, F.col("tight") if tight is None else tight
    return level * 2 + tight.cast("long")


def _level():
    """Sets whose sizes differ by more than a factor 1/0.8 cannot reach the threshold, so only equal and neighbouring levels can."""
    return F.floor(F.log(F.col("size").cast("double")) / math.log(1 / THRESHOLD) + 1e-9).cast("long")


def _tasks(members: DataFrame, large: DataFrame) -> DataFrame:
    """Adds the pairs of blocks (first, second) that each member takes part in, and its own block.

    ``members``: node, root, size, tight. A component that isn't ``large`` is one block. Tight members of one component are known to be linked, so
    their blocks meet only others. The join is salted, so that no task gets a component whole.
    """
    width = 1 << 20
    known = join_salted(members.withColumn("_spread", F.xxhash64("node")), large, ["root"], "_spread", "left").withColumn("level", _level())

    def blocks_of(kind):
        parts = F.col("parts")[kind]
        return F.when(parts.isNull(), F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda s: kind * width + s))

    own = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(_kind() * width + F.pmod(F.xxhash64("node"), F.col("parts")[_kind()]))
    loose = F.concat(*(blocks_of(_kind(F.col("level") + d, F.lit(False))) for d in (-1, 0, 1)))
    tight = F.concat(*(blocks_of(_kind(F.col("level") + d, F.lit(True))) for d in (-1, 0, 1)))
    near = F.when(F.col("tight"), loose).otherwise(F.concat(loose, tight))
    return (
        known.withColumn("block", own.cast("long"))
        .withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(near)))
        .select("node", "root", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    )


class Forest:
    """Least members of sets that merge."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def merge(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)


def unpruned(i: int, js: np.ndarray, signatures: np.ndarray, needed: list[int]) -> np.ndarray:
    """Those of ``js`` whose signatures don't rule out that their sets and set ``i`` reach the threshold."""
    matches = np.zeros(len(js), int)
    for k, least in enumerate(needed):
        if not len(js):
            break
        span = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (signatures[js, span] == signatures[i, span]).sum(axis=1)
        keep = matches >= least
        js, matches = js[keep], matches[keep]
    return js


def comparable(i: int, sizes: np.ndarray, side: np.ndarray, within: bool) -> np.ndarray:
    """Later members that ``i`` is compared with: of the other side or, within a block, all; sizes apart rule a pair out."""
    js = np.arange(i + 1, len(sizes))
    if not within:
        js = js[side[js] != side[i]]
    return js[np.minimum(sizes[js], sizes[i]) >= THRESHOLD * np.maximum(sizes[js], sizes[i]) - 1e-9]


def links_in_block(sets: list[np.ndarray], signatures: np.ndarray, side: np.ndarray, within: bool, needed: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j), i < j, at the threshold; of both sides, or within the one.

    Row by row: pruned by the signatures, then intersections counted through the postings of the row's shingles.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(ids, kind="stable")
    postings, starts = owner[order], np.r_[0, np.cumsum(np.bincount(ids))]
    at = np.r_[0, np.cumsum(sizes)]
    found = []
    for i in range(n - 1):
        js = unpruned(i, comparable(i, sizes, side, within), signatures, needed)
        if len(js):
            mine = ids[at[i] : at[i + 1]]
            lengths = starts[mine + 1] - starts[mine]
            flat = np.repeat(starts[mine] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            both = np.bincount(postings[flat], minlength=n)[js]
            js = js[both >= THRESHOLD * (sizes[js] + sizes[i] - both) - 1e-9]
            found += [(i, int(j)) for j in js]
    return found


def _runs(batches, names=("root", "first", "second")):
    """((root, first, second), rows) of rows sorted by these; one run, at most two blocks, is held at a time."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[n] for n in names)
            if now != key:
                if rows:
                    yield key, rows
                key, rows = now, []
            rows.append(row)
    if rows:
        yield key, rows


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _prune(batches):
    """One forest edge for each class that has a pair, in its bucket, which its signature doesn't rule out.

    A member is compared only with members that nothing before has joined to it: of a bucket of near copies, the first with each other.
    """
    for (_, first, second), rows in _runs(batches, ("bucket", "first", "second")):
        rows = sorted({r["node"]: r for r in rows}.values(), key=lambda r: r["node"])
        signatures = np.stack([np.frombuffer(r["signature"], "<u2") for r in rows])
        sizes, side = (np.array([r[c] for r in rows]) for c in ("size", "block"))
        label, edges = np.arange(len(rows)), []
        for i in range(len(rows) - 1):
            js = comparable(i, sizes, side, first == second)
            js = unpruned(i, js[label[js] != label[i]], signatures, NEEDED)
            for j in js.tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    edges.append((rows[i]["node"], rows[j]["node"]))
        yield _batch(edges, ["u", "v"])


def _verify(batches):
    memo = WordHashes()
    for (_, first, second), rows in _runs(batches):
        kept = {}
        for row in rows:
            if row["node"] not in kept:
                s = shingle_set(row["text"], SHINGLE, memo)
                if set_key(s) == (row["key_a"], row["key_b"]):
                    kept[row["node"]] = (row["node"], row["copies"], row["block"], s, row["signature"])
        if len(kept) < 2:
            continue
        members = sorted(kept.values(), key=lambda x: x[0])
        links, forest = [0] * len(members), Forest(len(members))
        signatures = np.stack([np.frombuffer(x[4], "<u2") for x in members])
        side = np.array([x[2] for x in members])
        for i, j in links_in_block([x[3] for x in members], signatures, side, first == second, NEEDED):
            links[i] += members[j][1]
            links[j] += members[i][1]
            forest.merge(i, j)
        yield _batch([(x[0], links[i], members[forest.root(i)][0]) for i, x in enumerate(members) if links[i]], ["node", "links", "parent"])


def _dealt(tasks: DataFrame, by: str) -> DataFrame:
    """Rows of a task together, tasks dealt over the partitions."""
    partitions = max(1, int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return tasks.repartition(partitions, by, "first", "second").sortWithinPartitions(by, "first", "second")


def _bucket_blocks(shared: DataFrame) -> DataFrame:
    """Rows (bucket, node, n) with the pairs of blocks (first, second) of their bucket that they take part in."""
    parts = F.ceil(F.col("n") / PRUNE_BLOCK)
    rows = shared.withColumn("block", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return rows.select("bucket", "node", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))


def _refined(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``members`` (node, root, size) with large components replaced by those of the pairs that signatures leave.

    Only members of one bucket are compared, so a chain of buckets, however long, makes work in proportion to it.
    """
    large = materialise(members.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "large")
    if large.isEmpty():
        return members
    inside = join_salted(members.withColumn("_spread", F.xxhash64("node")), large.select("root", F.lit(True).alias("is_large")), ["root"], "_spread", "left")
    inside = materialise(inside, "by-size")
    suspects = classes.join(inside.where("is_large").select("node"), "node", "left_semi")
    rows = _buckets(suspects)
    several = rows.groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"mark_{k}") for k in (1, 2)]).where("n > 1")
    once = several.groupBy("mark_1", "mark_2", "n").agg(F.min("bucket").alias("bucket"))  # buckets of the same members are one
    shared = join_salted(rows.withColumn("_spread", F.xxhash64("node")), once.select("bucket", "n"), ["bucket"], "_spread", salts=8)
    tasks = _bucket_blocks(shared).join(suspects.select("node", "size", "signature"), "node")
    edges = materialise(_dealt(tasks, "bucket").mapInArrow(_prune, "u long, v long"), "unpruned")
    again = components(edges, "pruned").distinct().join(classes.select("node", "size"), "node").select("node", "root", "size")
    return materialise(inside.where("is_large is null").select("node", "root", "size").union(again), "members")


def _tight_sets():
    """Judges whether a set's distance to its leader's is at most half the distance of a link."""
    memo, most = WordHashes(), (1 - THRESHOLD) / 2

    def ready(head, row=None):
        if row is None:
            return shingle_set(head["text"], SHINGLE, memo)
        other = shingle_set(row["text"], SHINGLE, memo)
        both = len(np.intersect1d(head, other, assume_unique=True))
        return both >= (1 - most) * (len(head) + len(other) - both) + 1e-9

    return ready


def _tight(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, leader): of large components the members at most half a link's distance from their leader, itself included.

    Jaccard distance is a metric, so any two of them are linked: they are counted, never compared with each other. The leader is the member
    whose buckets are fullest, as the origin of a group of copies is.
    """
    large = members.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("root")
    inside = materialise(join_salted(members.withColumn("_spread", F.xxhash64("node")), large.withColumn("_in", F.lit(True)), ["root"], "_spread").select("node", "root"), "in-large")
    if inside.isEmpty():
        return inside.select("node", F.col("root").alias("leader"))
    rows = _buckets(classes.join(inside.select("node"), "node", "left_semi"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowd = join_salted(rows.withColumn("_spread", F.xxhash64("node")), full, ["bucket"], "_spread", salts=8).groupBy("node").agg(F.sum("n").alias("crowd"))
    leaders = inside.join(crowd, "node").groupBy("root").agg(F.max(F.struct("crowd", (-F.col("node")).alias("less"))).alias("_most")).select("root", (-F.col("_most.less")).alias("u"))
    edges = join_salted(inside.withColumn("_spread", F.xxhash64("node")), leaders, ["root"], "_spread").where("node <> u").select("u", F.col("node").alias("v"))
    near = materialise(met(edges, texts, _tight_sets, "to-leaders"), "tight")
    return near.select(F.col("v").alias("node"), F.col("u").alias("leader")).union(near.select("u", "u").distinct())


def jaccard_join(documents: DataFrame) -> DataFrame:
    """doc_id, copy_class, class_id, n_links and n_copies for every row.

    copy_class: the least doc_id with the same shingle set. class_id: the least doc_id of the component of
    links. n_links: rows, other than this, whose similarity is 0.8 or more; copies count. n_copies: rows with the same set.

    Texts without words (nulls too) all have the empty set, and are copies of each other and link to
    nothing else. A text of fewer than five words is one shingle; a very long one counts whole. Rows with a null doc_id take part in
    nothing: their class is null and their counts are 0. Repeated rows count as copies, and rows that repeat a doc_id with
    another text have the class and links of their own text. Least doc_ids decide ties. An empty table gives no rows, and other columns
    take no part.
    """
    return near_classes(documents).drop("text_hash")


def near_classes(documents: DataFrame) -> DataFrame:
    """What ``jaccard_join`` gives, and text_hash: with doc_id it tells apart the rows of a doc_id that has several texts."""
    features = materialise(shingle_features(documents), "shingles")
    keyed = features.where("doc_id is not null")
    classes = keyed.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    one = features.select(F.col("doc_id").alias("rep"), "text_hash", "key_a", "key_b", "size", "signature").dropDuplicates(["rep", "key_a", "key_b"])
    # rows of one doc_id with different texts give classes of the same rep, so a class has a number of its own
    classes = materialise(classes.join(one, ["rep", "key_a", "key_b"]).withColumn("node", F.monotonically_increasing_id()), "classes")
    stars = components(_bucket_edges(classes), "stars")
    members = _refined(materialise(classes.select("node", "size").join(stars, "node").select("node", "root", "size"), "starred"), classes)
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("text_hash"), "text")
    with_text = classes.join(members.select("node"), "node", "left_semi").join(texts, ["rep", "text_hash"]).drop("rep", "text_hash", "size")
    with_text = materialise(with_text, "members-texts")
    tight = materialise(_tight(members, classes, with_text.select("node", "text")), "tight-sets")
    members = materialise(members.join(tight.select("node", F.lit(True).alias("tight")), "node", "left").na.fill(False, ["tight"]), "told")
    tasks = _tasks(members, _large_roots(members))
    verified = _dealt(tasks.join(with_text, "node"), "root").mapInArrow(_verify, "node long, links long, parent long")
    counted = tight.join(classes.select("node", "copies"), "node")
    totals = counted.groupBy("leader").agg(F.sum("copies").alias("total"))
    among = join_salted(counted.withColumn("_spread", F.xxhash64("node")), totals, ["leader"], "_spread").select("node", (F.col("total") - F.col("copies")).alias("links"), F.col("leader").alias("parent"))
    verified = materialise(verified.union(among), "links")
    roots = components(verified.select(F.col("node").alias("u"), F.col("parent").alias("v")), "linked")
    linked = roots.join(classes.select("node", "rep"), "node")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        classes.select("key_a", "key_b", "rep", "copies", "node")
        .join(links, "node", "left")
        .join(linked.join(least, "root").select("node", "least"), "node", "left")
    )
    known = materialise(known.select("key_a", "key_b", "rep", F.col("copies").alias("n"), "links", "least"), "known")
    # classes of very many copies are few, and are joined apart, salted: no task gets one whole
    rows = features.select("doc_id", "text_hash", "key_a", "key_b")
    hot = join_salted(rows.withColumn("_spread", F.xxhash64("doc_id", "text_hash")), known.where(F.col("n") > HOT_COPIES), ["key_a", "key_b"], "_spread", "left")
    usual = hot.where("n is null and doc_id is not null").select(*rows.columns).join(known.where(F.col("n") <= HOT_COPIES), ["key_a", "key_b"], "left")
    has_id = F.col("doc_id").isNotNull()
    return hot.where("n is not null or doc_id is null").unionByName(usual).select(
        "doc_id",
        F.when(has_id, F.col("rep")).alias("copy_class"),
        F.when(has_id, F.coalesce("least", "rep")).alias("class_id"),
        F.when(has_id, F.col("n") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(has_id, F.col("n")).otherwise(0).cast("long").alias("n_copies"),
        "text_hash",
    )
