import glob
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from textloom.sources import vector_store

VECTORS = "k string, v array<double>, vec string"


def vectors(seed, n, first=0):
    rng = np.random.default_rng(seed)
    return [(f"key{k:05}", rng.normal(size=48).tolist(), "mine") for k in range(first, first + n)]


def as_half(v):
    return np.array(v).astype(np.float16).astype(np.float32).tolist()


def test_round_trip_is_exact_to_half_precision(table, spark, tmp_path):
    rows = vectors(1, 300) + [("", [0.0, -0.0, 1e-9, 65504.0], "x"), ("ü", [1 / 3], "x"), ("empty", [], "x")]
    random.Random(1).shuffle(rows)
    vector_store.write(table(VECTORS, rows), f"{tmp_path}/s", "k", "v", 4)
    got = {r.k: r.vec for r in vector_store.load(spark, f"{tmp_path}/s", "k").collect()}
    assert got == {k: as_half(v) for k, v, _ in rows}


def test_a_lookup_reads_the_files_and_row_groups_around_its_keys(table, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_store, "GROUP_BYTES", 4096)
    rows, path = vectors(2, 3000), f"{tmp_path}/s"
    vector_store.write(table(VECTORS, rows), path, "k", "v", 8)
    assert len(glob.glob(f"{path}/vectors/*.parquet")) == 8
    assert len(vector_store.files_of(spark, path, ["key00007"])) == 1 and len(vector_store.files_of(spark, path, ["key00000", "key02999"])) == 2
    assert vector_store.files_of(spark, path, ["zzz"]) == [] and vector_store.lookup(spark, path, ["zzz"], "k").collect() == []
    file = pq.ParquetFile(f"{path}/vectors/{vector_store.files_of(spark, path, ['key01234'])[0]}")
    bounds = [file.metadata.row_group(k).column(0).statistics for k in range(file.num_row_groups)]
    assert file.num_row_groups > 3 and sum(b.min <= "key01234" <= b.max for b in bounds) == 1
    wanted = ["key00003", "key01234", "key02999", "absent"]
    assert {r.k: r.vec for r in vector_store.lookup(spark, path, wanted, "k").collect()} == {k: as_half(v) for k, v, _ in rows if k in wanted}
    plan = vector_store.lookup(spark, path, wanted, "k")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(k," in plan


def test_the_first_store_decides(table, spark, tmp_path):
    a, b = vectors(3, 40), vectors(4, 60, 20)
    for name, rows in (("a", a), ("b", b)):
        vector_store.write(table(VECTORS, rows), f"{tmp_path}/{name}", "k", "v", 2)
    vector_store.merge(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], f"{tmp_path}/ab", "k", 3)
    want = {k: as_half(v) for k, v, _ in b} | {k: as_half(v) for k, v, _ in a}
    assert {r.k: r.vec for r in vector_store.load(spark, f"{tmp_path}/ab", "k").collect()} == want and len(want) == 80


@pytest.mark.parametrize("row", [("a", [1.0, None], "x"), ("a", [70000.0], "x"), ("a", [float("nan")], "x"), ("a", None, "x"), (None, [1.0], "x")])
def test_what_has_no_half_is_an_error(table, tmp_path, row):
    with pytest.raises(Exception, match="half-precision"):
        vector_store.write(table(VECTORS, [row]), f"{tmp_path}/s", "k", "v")


def test_repeated_keys_empty_stores_and_bounds(table, spark, tmp_path):
    vector_store.write(table(VECTORS, [("a", [2.0], "x"), ("a", [1.0], "x"), ("a", [1.0], "y")]), f"{tmp_path}/s", "k", "v")
    assert [r.vec for r in vector_store.load(spark, f"{tmp_path}/s", "k").collect()] == [[1.0]]
    assert vector_store.load(spark, f"{tmp_path}/s", "k").count() == 1
    vector_store.write(table(VECTORS, []), f"{tmp_path}/e", "k", "v")
    assert vector_store.load(spark, f"{tmp_path}/e", "k").collect() == [] and vector_store.lookup(spark, f"{tmp_path}/e", ["a"], "k").collect() == []
    with pytest.raises(ValueError):
        vector_store.lookup(spark, f"{tmp_path}/s", [str(k) for k in range(10_001)], "k")
