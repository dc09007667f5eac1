import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import compare
from textloom.sources import stores


def test_staging_tables_are_checked(spark, table, tmp_path):
    path = str(tmp_path / "t")
    stores.save_table(table("b long, a string", [(1, "x"), (2, None)]), path, "a string, b long", {"b": "b > 0"}, "b")
    assert stores.load_table(spark, path, "a string, b long").columns == ["a", "b"] and stores.load_table(spark, path, "a string, b long", ["b"]).count() == 2
    with pytest.raises(ValueError, match="columns"):
        stores.save_table(table("a string", [("x",)]), path, "a string, b long")
    with pytest.raises(ValueError, match="unique"):
        stores.save_table(table("a string, b long", [("x", 1), ("y", 1)]), path, "a string, b long", unique="b")
    assert stores.load_table(spark, path, "a string, b long").count() == 2
    with pytest.raises(FileNotFoundError, match="nowhere"):
        stores.load_table(spark, str(tmp_path / "nowhere"), "a string")
    stores.save_derived(table("work_id string, start long, end long", [("w", 0, 4)]), str(tmp_path), "sentences")
    assert stores.load_derived(spark, str(tmp_path), "sentences", ["work_id"]).first().work_id == "w"


def test_cache_computes_new_texts_only(spark, table, tmp_path):
    path, seen = str(tmp_path / "cache"), []

    def compute(df):
        seen.append(df.count())
        return df.withColumn("size", F.length("t"))

    first = stores.with_cached(table("k long, t string", [(1, "aa"), (2, "aa"), (3, None)]), "t", path, compute, "size int")
    assert sorted((r.k, r.size) for r in first.collect()) == [(1, 2), (2, 2), (3, None)]
    second = stores.with_cached(table("k long, t string", [(1, "aa"), (4, "bbb")]), "t", path, compute, "size int")
    assert sorted((r.k, r.size) for r in second.collect()) == [(1, 2), (4, 3)] and seen == [1, 1]


def test_linked_records_and_ids(spark, table, tmp_path):
    path = str(tmp_path / "linked")
    rows = table("work_id string, identifier string", [("w1", "a"), ("w2", "b")])
    assert [stores.append_linked(rows, path, {"identifier": "identifier is not null"}) for _ in range(2)] == [2, 0]
    with pytest.raises(ValueError, match="identifier"):
        stores.append_linked(table("work_id string, identifier string", [("w3", None), ("w4", "x")]), path, {"identifier": "identifier is not null"})
    assert sorted(r.work_id for r in stores.record_ids(spark, path, "work_id").collect()) == ["w1", "w2"]


def test_listings(spark, table, tmp_path):
    for name in ("ai/1990", "ai/2000", "law/2000"):
        where = tmp_path / f"{name}.jsonl.gz"
        where.parent.mkdir(exist_ok=True)
        where.write_bytes(b"x" * 7)
    cells = stores.list_cells(spark, str(tmp_path))
    assert sorted((r.field, r.decade, r.bytes) for r in cells.collect()) == [("ai", 1990, 7), ("ai", 2000, 7), ("law", 2000, 7)]
    assert stores.select_cells(cells, ["ai"], [2000]).count() == 1
    with pytest.raises(ValueError, match="no cell"):
        stores.select_cells(cells, ["law"], [1990])
    assert stores.list_cells(spark, str(tmp_path / "none")).count() == 0
    path = str(tmp_path / "vectors")
    for value in (1.0, 2.0):
        stores.save_vectors(table("field string, decade long, word string, vec array<double>", [("ai", 1990, "w", [value])]), path)
    stores.save_vectors(table("field string, decade long, word string, vec array<double>", [("law", 2000, "w", [3.0])]), path)
    assert sorted(r.vec[0] for r in stores.load_vectors(spark, path).collect()) == [2.0, 3.0] and stores.load_vectors(spark, path, "law").count() == 1
    assert [tuple(r) for r in stores.missing_cells(cells, stores.list_models(spark, path)).collect()] == [("ai", 2000)]


def test_metrics_and_runs(spark, tmp_path):
    stores.save_metrics(spark, {"b": {"x": 1}, "a": 2}, str(tmp_path / "m"))
    assert stores.load_metrics(spark, str(tmp_path / "m")) == {"a": 2, "b": {"x": 1}}
    for k in range(2):
        stores.record_run(spark, str(tmp_path / "log"), "build", {"k": k}, {"read": 1.5}, {"works": 10 + k})
    out = stores.runs(spark, str(tmp_path / "log")).collect()
    assert [json.loads(r.parameters)["k"] for r in out] == [0, 1] and out[1].rows["works"] == 11


def test_small_readers(spark, tmp_path):
    (tmp_path / "s.toml").write_text('[mind]\nbrain = ["<the", "neural"]\n')
    assert stores.read_sense_lists(str(tmp_path / "s.toml")) == {"mind": {"brain": ["<the", "neural"]}}
    (tmp_path / "bad.toml").write_text('[mind]\nbrain = ["the brain"]\n')
    with pytest.raises(ValueError):
        stores.read_sense_lists(str(tmp_path / "bad.toml"))
    (tmp_path / "u.tsv").write_text('lemma\tidentifier\tgrouping\tcontext\tindexes_target_token\nplane\ti1\t1\tthe "plane flew\t5:10\n')
    assert tuple(stores.read_usages(spark, str(tmp_path / "u.tsv")).first()) == ("plane", "i1", "1", 'the "plane flew', 5, 10)
    (tmp_path / "g.tsv").write_text("lemma\tchange_graded\nplane_nn\t0.88\n")
    assert tuple(stores.read_graded_change(spark, str(tmp_path / "g.tsv")).first()) == ("plane", 0.88)
    where = tmp_path / "raw" / "ai" / "texts"
    where.mkdir(parents=True)
    (where / "ai_1990.txt").write_text("one\ntwo\n")
    stores.rewrite_stage(spark, str(tmp_path), "raw", "upper", F.upper)
    assert sorted((r.value, r.source, r.name) for r in spark.read.text(str(tmp_path / "upper")).collect()) == [("ONE", "ai", "ai_1990"), ("TWO", "ai", "ai_1990")]


def test_differences(table):
    a, b = table("x string, y int", [("a", 1), ("a", 1), ("a", 1), (None, 2), ("b", 1)]), table("x string, y int", [("a", 1), ("b", 1), ("b", 1)])
    assert {tuple(r) for r in compare.multiset_difference(a, b, ["x", "y"]).collect()} == {("a", 1, 2), (None, 2, 1)}
    before = table("k int, t string", [(1, "same"), (2, "abcdef"), (3, None), (4, "abc"), (5, "x"), (6, "y" * 1000 + "a")])
    after = table("k int, t string", [(1, "same"), (2, "abcXef"), (3, "new"), (4, "abcd"), (7, "x"), (6, "y" * 1000 + "b")])
    assert {r.k: r.at for r in compare.text_changes(before, after, "k", "t").collect()} == {2: 3, 3: 0, 4: 3, 6: 1000}


def test_grid_builds_missing_cells_once(spark, table, tmp_path):
    from textloom.operators import embedding

    words = "red green blue red blue green red green".split()
    rows = [("ai", 1990, k, words[k % 3 :]) for k in range(6)] + [("law", 2000, k, words) for k in range(4)]
    lines, path = table("field string, decade long, k long, w array<string>", rows), str(tmp_path / "grid")
    assert embedding.build_grid(lines.where("field = 'ai'"), "w", "k", path, 2, 2, 2) == 1
    before = {r.word: r.vec for r in stores.load_vectors(spark, path, "ai").collect()}
    assert embedding.build_grid(lines, "w", "k", path, 2, 2, 2) == 1 and embedding.build_grid(lines, "w", "k", path, 2, 2, 2) == 0
    assert {r.word: r.vec for r in stores.load_vectors(spark, path, "ai").collect()} == before
    assert {r.field for r in stores.load_vectors(spark, path).collect()} == {"ai", "law"}


def test_static_view(table):
    from textloom.operators import embedding, patterns

    view = patterns.token_view(table("k long, t string", [(1, "Minds, of Planes."), (2, "...")]), "k", "t")
    out = {r.k: (r.words, r.starts) for r in embedding.static_view(view, "k", table("type string, lemma string", [("minds", "mind"), ("planes", "plane")])).collect()}
    assert out == {1: (["mind", "of", "plane"], [0, 7, 10])}
