"""Exact top-k inner-product search: ball-tree branch and bound in every shard, the current kth score shared between rounds.

A tree of median splits, fitted on a bounded sample, gives regions of near vectors; every vector goes to its region, and large
regions are cut by hash, so a shard holds a bounded number of rows. A task builds a shard's ball tree once and appends it to a file; a
table has each tree's place, its root's ball and its size. The ball around a region's roots bounds the inner products in it: q.c + |q| r.
Queries with the same vector are one. A query first searches the region with its best bound. After every round its kth
score so far goes on as a floor: the query is sent only to regions whose bound reaches it, three times
as many as in the round before and the best bounds first, and the floor grows until no region is left. Only queries move then, and only trees that
are asked are read. In a shard a ball tree's nodes
are visited by their bounds, and a subtree is left out when its bound is below the query's kth score.
"""

from __future__ import annotations

import heapq
import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import open_bytes, write_whole
from .shared import bounded_batches, join_salted, materialise, new_table_path

K = 20
SCALE = 64
SHARD_ROWS = 8192
LEAF = 128
#: Rows that the splits between regions are fitted on, and the most regions, of all lengths of vectors together: bounds of what is broadcast.
SAMPLE_ROWS = 20_000
MOST_REGIONS = 512
#: Regions that a query searches in the first round; later rounds take three times as many each.
FIRST_REGIONS, GROWTH = 1, 3
#: Squared lengths of vectors stay below this, so that no score, nor a part of its sum, exceeds 64 bits.
MOST_SQUARE = 2.0**63 * (1 - 1e-9)


def _bounds(centres: np.ndarray, radii: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Upper bounds of q's inner products in balls, with room for rounding."""
    norm = np.sqrt(q @ q)
    bounds = centres @ q + norm * radii
    return bounds + 1e-9 * np.abs(bounds) + 1e-6 * (1 + norm)


class BallTree:
    """Integer vectors in leaves of at most ``LEAF``, split at the median along the widest axis."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        # doubles hold the scores exactly while these are below 2**53
        small = not vectors.size or np.abs(vectors).max() < 2**20
        self.vectors = vectors.astype(np.float64 if small else np.int64)
        self.small = small
        self.order = np.arange(len(ids))
        self.centres, self.radii, self.spans, self.children = [], [], [], []
        self._build(0, len(ids))
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        self.vectors, self.ids = self.vectors[self.order], ids[self.order]

    def _build(self, start: int, end: int) -> int:
        own = self.vectors[self.order[start:end]].astype(np.float64)
        centre = own.mean(axis=0)
        node = len(self.spans)
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
        self.spans.append((start, end))
        self.children.append(None)
        if end - start > LEAF and self.radii[node] > 0:
            axis = int(own.var(axis=0).argmax())
            half = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(own[:, axis], half)]
            self.children[node] = (self._build(start, start + half), self._build(start + half, end))
        return node

    def packed(self) -> bytes:
        out = io.BytesIO()
        children = np.array([c or (-1, -1) for c in self.children], np.int64)
        for x in (self.vectors, self.ids, self.centres, self.radii, np.array(self.spans, np.int64), children):
            np.save(out, x, allow_pickle=False)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> BallTree:
        tree, source = cls.__new__(cls), io.BytesIO(data)
        tree.vectors, tree.ids, tree.centres, tree.radii, spans, children = (np.load(source, allow_pickle=False) for _ in range(6))
        tree.small = tree.vectors.dtype == np.float64
        tree.spans, tree.children = [tuple(s) for s in spans.tolist()], [None if c[0] < 0 else tuple(c) for c in children.tolist()]
        return tree

    def search(self, own: int, query: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, -id) of other rows than ``own``, best first; those below ``floor`` may be missing.

        ``ids`` are pairs of an id and a row number; ``own`` is a row number.
        """
        return [entry[:2] for entry in self.best(own, query, k, floor)]

    def best(self, own: int, query: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int, int]]:
        """What ``search`` gives, with the negative row number."""
        q = query.astype(np.float64)
        bounds = _bounds(self.centres, self.radii, q)
        exact = self.small and np.abs(query).max(initial=0) < 2**20
        best: list[tuple[int, int, int]] = []  # a heap whose first is the worst
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            least = best[0][0] if len(best) == k else None
            least = floor if least is None or floor is not None and floor > least else least
            if least is not None and -bound < least:
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            start, end = self.spans[node]
            block = self.vectors[start:end]
            scores = block @ q if exact else block.astype(np.int64) @ query.astype(np.int64)
            at = np.arange(end - start) if least is None else np.flatnonzero(scores >= least)
            for i in at:
                vec, row = self.ids[start + i].tolist()
                if row != own:
                    entry = (int(scores[i]), -vec, -row)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
        return sorted(best, reverse=True)


def fit_splits(sample: np.ndarray, regions: int) -> list[tuple[int, float, int, int]]:
    """Median splits (axis, cut, left, right) of a sample; a negative child -k is region k - 1."""
    splits: list[tuple[int, float, int, int]] = []
    leaves = 0

    def build(rows, wanted):
        nonlocal leaves
        axis = int(sample[rows].var(axis=0).argmax()) if len(rows) else 0
        cut = float(np.median(sample[rows, axis])) if len(rows) else 0.0
        low = sample[rows, axis] < cut
        if wanted < 2 or not low.any():
            leaves += 1
            return -leaves
        node = len(splits)
        splits.append((axis, cut, 0, 0))
        splits[node] = (axis, cut, build(rows[low], wanted // 2), build(rows[~low], wanted - wanted // 2))
        return node

    build(np.arange(len(sample)), regions)
    return splits


def regions_of(vectors: np.ndarray, splits: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The region of each vector."""
    out = np.zeros(len(vectors), np.int64)
    todo = [(0, np.arange(len(vectors)))] if splits else []
    while todo:
        node, rows = todo.pop()
        if node < 0:
            out[rows] = -node - 1
            continue
        axis, cut, left, right = splits[node]
        low = vectors[rows, axis] < cut
        todo += [(left, rows[low]), (right, rows[~low])]
    return out


def _matrix(column) -> np.ndarray:
    """A list column of equally long vectors."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(whole), -1)


def _placed(vectors: DataFrame, splits: dict[int, list]) -> DataFrame:
    """Adds the region of every vector."""

    def run(batches):
        for batch in batches:
            lengths = np.array(batch.column("length").to_pylist(), np.int64)
            region = np.zeros(batch.num_rows, np.int64)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                region[rows] = regions_of(_matrix(batch.column("vector").take(pa.array(rows))), splits.get(int(n), []))
            yield batch.append_column("region", pa.array(region))

    return vectors.mapInArrow(run, "vec_id long, row long, length int, vector array<long>, region long")


def _trees(shards: DataFrame) -> DataFrame:
    """Builds and writes the tree of every shard: length, region, cut, path, start and bytes of the tree, and n, centre and radius of its ball.

    ``shards``: length, region, cut, vec_id, row, vector. A task writes one file, under a name of its own and whole, so that only files of tasks that
    succeeded are known.
    """
    folder = new_table_path(shards.sparkSession, "trees")
    kinds = {"length": pa.int32(), "region": pa.int64(), "cut": pa.int64(), "path": pa.string(), "start": pa.int64(), "bytes": pa.int64(), "n": pa.int64(), "centre": pa.list_(pa.float64()), "radius": pa.float64()}

    def run(batches):
        path, index, at = f"{folder}/{uuid.uuid4().hex}.trees", [], 0

        def trees():
            nonlocal at
            key, held = None, []
            for batch in batches:
                keys = np.stack([np.array(batch.column(c).to_pylist(), np.int64) for c in ("length", "region", "cut")], axis=1)
                cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
                for start, stop in zip(cuts, [*cuts[1:], len(keys)]):
                    if tuple(keys[start]) != key and held:
                        yield built(key, held)
                        held = []
                    key = tuple(keys[start])
                    part = batch.slice(start, stop - start)
                    held.append((np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row")], axis=1), _matrix(part.column("vector"))))
            if held:
                yield built(key, held)

        def built(key, held):
            nonlocal at
            tree = BallTree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            data = tree.packed()
            index.append((*map(int, key), path, at, len(data), len(tree.ids), tree.centres[0].tolist(), float(tree.radii[0])))
            at += len(data)
            return data

        stream = trees()
        first = next(stream, None)
        if first is not None:
            import itertools

            write_whole(path, itertools.chain([first], stream))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), kinds.values())], list(kinds))

    dealt = shards.repartition("length", "region", "cut").sortWithinPartitions("length", "region", "cut")
    return materialise(dealt.mapInArrow(run, "length int, region long, cut long, path string, start long, bytes long, n long, centre array<double>, radius double"), "tree-index")


def _merged(balls: list[tuple[int, np.ndarray, float]]) -> tuple[int, np.ndarray, float]:
    n = sum(b[0] for b in balls)
    centre = sum(b[0] * b[1] for b in balls) / n
    return n, centre, max(b[2] + float(np.sqrt(((b[1] - centre) ** 2).sum())) for b in balls)


def _all_balls(index: DataFrame, lengths: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of these lengths the regions, centres and radii: merged in groups, of which at most ``MOST_REGIONS`` come to the driver."""

    def merge(table):
        rows = table.to_pydict()
        n, centre, radius = _merged([(n, np.array(c), r) for n, c, r in zip(rows["n"], rows["centre"], rows["radius"])])
        return pa.table({"length": pa.array(rows["length"][:1], pa.int32()), "region": pa.array(rows["region"][:1], pa.int64()), "n": pa.array([n], pa.int64()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius], pa.float64())})

    if not lengths:
        return {}
    known = index.where(F.col("length").isin(lengths)).select("length", "region", "n", "centre", "radius")
    merged = known.groupBy("length", "region").applyInArrow(merge, "length int, region long, n long, centre array<double>, radius double")
    found: dict[int, list] = {}
    for r in sorted(merged.collect(), key=lambda r: (r.length, r.region)):
        found.setdefault(r.length, []).append(r)
    return {n: (np.array([r.region for r in rs]), np.array([r.centre for r in rs]), np.array([r.radius for r in rs])) for n, rs in found.items()}


def _wanted(queries: DataFrame, balls: dict, taken: int, more: int) -> DataFrame:
    """Each query once for each of its next ``more`` regions, by bound, that can still hold one of its k best. Vectors of a length that isn't split have one region."""

    def run(batches):
        for batch in batches:
            rows, regions = [], []
            for i, (vector, floor) in enumerate(zip(batch.column("vector").to_pylist(), batch.column("floor").to_pylist())):
                if len(vector) not in balls:
                    rows += [i] * (taken == 0)
                    regions += [0] * (taken == 0)
                    continue
                numbers, centres, radii = balls[len(vector)]
                bounds = _bounds(centres, radii, np.array(vector, np.float64))
                order = np.argsort(-bounds, kind="stable")[taken : taken + more]
                order = order if floor is None else order[bounds[order] >= floor]
                rows += [i] * len(order)
                regions += numbers[order].tolist()
            yield batch.take(pa.array(rows, pa.int64())).append_column("region", pa.array(regions, pa.int64()))

    return queries.mapInArrow(run, "query long, length int, vector array<long>, floor long, region long")


def _search_trees(asked: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, row, score): the k best of each query in each tree that it asks. Rows of a tree come together, and it is read once.

    ``asked``: path, start, bytes, query, vector, floor.
    """

    def run(batches):
        key, tree = None, None
        for batch in batches:
            out = ([], [], [], [])
            for path, start, size, query, vector, floor in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "bytes", "query", "vector", "floor"))):
                if (path, start) != key:
                    key = (path, start)
                    with open_bytes(path) as f:
                        f.seek(start)
                        tree = BallTree.unpacked(f.read(size))
                for score, vec, row in tree.best(-1, np.array(vector, np.int64), k, floor):
                    for column, value in zip(out, (query, -vec, -row, score)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query", "vec_id", "row", "score"])

    dealt = asked.select("path", "start", "bytes", "query", "vector", "floor").repartition("path", "start").sortWithinPartitions("path", "start")
    return dealt.mapInArrow(run, "query long, vec_id long, row long, score long")


def exact_top_k(embeddings: DataFrame, every: int = 20, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose vec_id is divisible by ``every``, the k best of all other rows.

    Components become floor(64 x). Vectors that are null, empty or hold a null or a non-finite component take no part, nor
    do rows with a null vec_id. Rows count, not ids: rows that repeat a vec_id are candidates each, for each other too, and each
    is a query of its own. A vector meets only vectors of its own length. Ties go to the smaller vec_id. An empty table gives
    no rows; other columns take no part. Where the square of a vector's length reaches 2**63, scores may exceed 64 bits, which is an error.
    """
    x = F.col("embedding")
    usable = F.coalesce(F.size(x), F.lit(0)) > 0
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    vectors = materialise(
        bounded_batches(embeddings).where(F.col("vec_id").isNotNull() & usable & F.coalesce(finite, F.lit(False))).select(
            F.col("vec_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.size(x).alias("length"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("vector")
        ),
        "vectors",
    )
    square = F.aggregate("vector", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    lengths = materialise(vectors.groupBy("length").agg(F.count("*").alias("n"), F.max(square).alias("square")), "lengths")
    if not lengths.where(F.col("square") >= MOST_SQUARE).isEmpty():
        raise ValueError("components are so large that scores may exceed 64 bits")
    # the lengths with most vectors are split; one that isn't has a single region, cut by hash
    large = [(r.length, r.n) for r in lengths.where(F.col("n") > shard_rows).orderBy(F.desc("n"), "length").limit(MOST_REGIONS).collect()]
    total, splits = sum(n for _, n in large), {}
    if large:
        chosen = F.pmod(F.xxhash64("vec_id", "row"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / total) * (1 << 30))
        sample = vectors.where(F.col("length").isin([n for n, _ in large]) & chosen).select("length", "vector").toArrow()
        sampled = np.array(sample.column("length").to_pylist())
        for length, n in large:
            regions = min(-(-n // shard_rows), max(1, MOST_REGIONS * n // total))
            rows = np.flatnonzero(sampled == length)
            if regions > 1 and len(rows):
                splits[length] = fit_splits(_matrix(sample.column("vector").take(pa.array(rows))), regions)
    placed = _placed(vectors, splits).withColumn("_spread", F.xxhash64("row"))
    placed = materialise(placed, "placed")
    sizes = placed.groupBy("length", "region").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("cuts")).where("cuts > 1")
    cut = join_salted(placed.withColumn("_s", F.col("_spread")), sizes, ["length", "region"], "_s", "left")
    index = _trees(cut.select("length", "region", F.coalesce(F.pmod("_spread", "cuts"), F.lit(0)).alias("cut"), "vec_id", "row", "vector"))
    balls = _all_balls(index, sorted(splits))
    trees = index.select("length", "region", "path", "start", "bytes")
    asking = placed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "row", "length", "vector", "_spread")
    queries = materialise(asking.groupBy("length", "vector").agg(F.min("row").alias("query")), "queries")
    # one more than k, as a query's own row may be among them
    best = lambda df: df.withColumn("_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))).where(F.col("_rank") <= k + 1)
    found, taken, more = None, 0, FIRST_REGIONS
    while True:
        known = queries.withColumn("floor", F.lit(None).cast("long"))
        if found is not None:
            floors = found.where(F.col("_rank") == k + 1).select("query", F.col("score").alias("floor"))
            known = queries.join(floors, "query", "left")
        wanted = materialise(_wanted(known.select("query", "length", "vector", "floor"), balls, taken, more), "wanted")
        if found is not None and wanted.isEmpty() and taken >= max((len(b[0]) for b in balls.values()), default=1):
            break
        now = _search_trees(wanted.join(trees, ["length", "region"]), k + 1)
        found = materialise(best(now if found is None else found.drop("_rank").union(now)), "best")
        taken, more = taken + more, GROWTH * more
    each = join_salted(asking, queries, ["length", "vector"], "_spread").select("query_id", F.col("row").alias("own"), "query")
    ranked = each.join(found, "query").where(F.col("row") != F.col("own"))
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
