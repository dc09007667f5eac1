import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from textloom.sources import revisions

ROWS = "k long, text string, part string, tags array<string>, n double"


def rows_of(df):
    return sorted(map(repr, df.collect()))


def folders(path):
    return sorted(os.listdir(f"{path}/data"))


def test_every_build_is_read_as_it_was(table, spark, tmp_path):
    path = str(tmp_path / "corpus")
    first = table(ROWS, [(1, "a", "x", ["t"], 1.5), (2, "b", "y", None, None), (2, "b", "y", None, None), (3, None, None, [], 0.0)])
    second = table(ROWS, [(1, "a", "x", ["t"], 1.5), (2, "b", "y", None, None), (3, None, None, [], 0.0), (4, "new", "z/é =", [], 1.0)])
    one, two = revisions.commit(first, path, "one", "part"), revisions.commit(second, path, "two", "part")
    assert (one["number"], two["number"]) == (1, 2) and set(two["parts"]) == {"x", "y", "null", "z/é ="}
    shared = {p for p in one["parts"] if one["parts"][p] == two["parts"].get(p)}
    assert shared == {"x", "null"}  # a repeated row makes another part
    written = [f for _, _, names in os.walk(f"{path}/data/{folders(path)[0]}") for f in names if f.endswith(".parquet")]
    assert len(folders(path)) == 2 and written
    named = lambda df: df.fillna({"part": "null"})
    assert rows_of(revisions.read(spark, path, "one")) == rows_of(named(first)) and rows_of(revisions.read(spark, path)) == rows_of(named(second))
    assert rows_of(revisions.read(spark, path, "two", ["x", "z/é ="])) == rows_of(second.where("part in ('x', 'z/é =')"))
    assert revisions.read(spark, path, "one").schema == first.schema


def test_an_unchanged_build_writes_no_data(table, spark, tmp_path):
    path, rows = f"file://{tmp_path}/c", table(ROWS, [(1, "a", "x", [], 1.0)])
    revisions.commit(rows, path, "1", "part")
    revisions.commit(rows.repartition(3), path, "2", "part")
    assert len(folders(tmp_path / "c")) == 1 and rows_of(revisions.read(spark, path, "2")) == rows_of(rows)


def test_a_killed_writer_never_shows(table, spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "c"), table(ROWS, [(1, "a", "x", [], 1.0), (2, "b", "y", [], 1.0)])
    revisions.commit(rows.where("k = 1"), path, "1", "part")
    real = os.link
    monkeypatch.setattr(os, "link", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # after the data are written and before the commit stands
        revisions.commit(rows, path, "2", "part")
    monkeypatch.setattr(os, "link", real)
    assert [m["build"] for m in revisions.log(spark, path)] == ["1"] and revisions.read(spark, path).count() == 1
    open(f"{path}/log/00000002.json.dead.unfinished", "w").write("{")  # half a manifest of another
    revisions.commit(rows, path, "2", "part")
    assert rows_of(revisions.read(spark, path, "2")) == rows_of(rows)


def test_writers_at_the_same_time(table, spark, tmp_path):
    path, rows = str(tmp_path / "c"), table(ROWS, [(1, "a", "x", [], 1.0)])

    def write(name):
        try:
            return revisions.commit(rows, path, name, "part")["number"]
        except FileExistsError:
            return "late"

    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(write, ["a", "b", "c", "d", "same", "same"]))
    assert sorted(x for x in done if x != "late") == [1, 2, 3, 4, 5] and done.count("late") == 1
    assert sorted(m["build"] for m in revisions.log(spark, path)) == ["a", "b", "c", "d", "same"]
    assert all(rows_of(revisions.read(spark, path, b)) == rows_of(rows) for b in "abcd")


def test_put_if_absent(spark, tmp_path):
    assert revisions.put_if_absent(spark, f"{tmp_path}/a/x.json", json.dumps(1)) and not revisions.put_if_absent(spark, f"{tmp_path}/a/x.json", "2")
    assert os.listdir(tmp_path / "a") == ["x.json"] and open(tmp_path / "a" / "x.json").read() == "1"


def test_empty_builds_and_missing_ones(table, spark, tmp_path):
    path = str(tmp_path / "c")
    assert revisions.log(spark, path) == []
    with pytest.raises(FileNotFoundError):
        revisions.read(spark, path)
    revisions.commit(table(ROWS, []), path, "none", "part")
    assert revisions.read(spark, path).collect() == [] and revisions.read(spark, path).columns == ["k", "text", "part", "tags", "n"]
    with pytest.raises(FileExistsError):
        revisions.commit(table(ROWS, []), path, "none", "part")
    with pytest.raises(FileNotFoundError, match="p, q"):
        revisions.read(spark, path, "none", ["q", "p"])
