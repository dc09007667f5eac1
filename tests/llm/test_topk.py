import math
import random

import numpy as np
import pytest

from textloom.llm import topk


def brute(rows, every, k):
    """Every usable row against all others."""
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(usable):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, w)), j) for b, (j, w) in enumerate(usable) if b != a and len(w) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, [round(rng.gauss(0, 1), 2) for _ in range(6)], 0) for k in range(400)]
    rows += [(500 + k, [0.5] * 6, 0) for k in range(60)] + [(600, None, 0), (620, [], 0), (640, [float("nan")] * 6, 0), (660, [None] + [1.0] * 5, 0), (680, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (700, [1.0, 2.0], 0), (720, [1.0, 2.0], 0), (20, [9.0] * 6, 1), (20, rows[20][1], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    out = topk.exact_top_k(df, shard_rows=90)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out.collect()) == brute(rows, 20, 20)
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_candidates(spark):
    """Each with its own score, and found by the other."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 0.0]), (20, [1.0, 1.0]), (20, [0.0, 2.0])]
    got = sorted(tuple(r) for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == brute(rows, 20, 20) and (0, 1, 1, 4096) in got and (0, 3, 1, 2048) in got


def test_regions_share_the_kth_score(spark, monkeypatch):
    """Clusters apart: most queries never go beyond the regions near them, and the result stays exact."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3, (8, 6))
    vectors = centres[np.arange(900) % 8] + rng.normal(0, 0.02, (900, 6))
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(vectors)]
    asked, real = [], topk._wanted

    def counted(*args):
        out = real(*args)
        asked.append(out.count())
        return out

    monkeypatch.setattr(topk, "_wanted", counted)
    out = topk.exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), shard_rows=60)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 20, 20)
    assert sum(asked) < 45 * 8 < 45 * 15


def test_query_equals_its_sql(spark, small):
    import duckdb

    from textloom.llm import queries

    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
        wanted = db.execute(queries.oracle_sql()["op4_exact_top_k"]).fetchall()
    assert sorted(tuple(r) for r in queries.op4_exact_top_k(spark, small).collect()) == sorted(wanted)


def test_tree_leaves_subtrees_out():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 400, (40, 16))
    vectors = (centres[rng.integers(0, 40, 4000)] + rng.normal(0, 5, (4000, 16))).astype(np.int64)
    tree = topk.BallTree(np.stack([np.arange(4000)] * 2, axis=1), vectors)
    visited = []
    real = tree.spans
    tree.spans = type("Counted", (list,), {"__getitem__": lambda s, k: visited.append(k) or list.__getitem__(s, k)})(real)
    got = tree.search(-1, vectors[7], 20, None)
    scores = vectors @ vectors[7]
    assert got == sorted(((int(s), -i) for i, s in enumerate(scores)), reverse=True)[:20]
    assert len(visited) < len(real) / 4


@pytest.mark.parametrize("x", [64e9, 1e300])
def test_scores_beyond_64_bits_are_an_error(spark, x):
    df = spark.createDataFrame([(0, [x]), (1, [x])], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.exact_top_k(df)


def test_scores_near_the_bound_are_exact(spark):
    rows = [(k, [4e7 + k, -3e6, 1.0 * k]) for k in range(50)]
    got = sorted(tuple(r) for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == brute(rows, 20, 20) and got[0][3] > 2**60


def test_a_tree_survives_packing():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-9, 9, (700, 5))
    tree = topk.BallTree(np.stack([np.arange(700)] * 2, axis=1), vectors)
    again = topk.BallTree.unpacked(tree.packed())
    for q in vectors[:20]:
        assert again.best(3, q, 7, None) == tree.best(3, q, 7, None)
    assert again.spans == tree.spans and again.children == tree.children


def test_equal_queries_are_asked_once_and_trees_written_once(spark, monkeypatch):
    """A vector that most rows share is one query; after the trees are written, only queries move."""
    rng = random.Random(8)
    rows = [(k, [0.5, 0.25]) for k in range(600)] + [(1000 + k, [rng.gauss(0, 1), rng.gauss(0, 1)]) for k in range(200)]
    asked, written = [], []
    real, trees = topk._wanted, topk._trees

    def counted(*args):
        out = real(*args)
        asked.append(out.select("query").distinct().count())
        return out

    def once(shards):
        out = trees(shards)
        written.append(sum(r.n for r in out.collect()))
        return out

    monkeypatch.setattr(topk, "_wanted", counted)
    monkeypatch.setattr(topk, "_trees", once)
    got = sorted(tuple(r) for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), shard_rows=50).collect())
    assert got == brute(rows, 20, 20)
    assert asked[0] == 11 and max(asked) <= 11 and written == [800]
