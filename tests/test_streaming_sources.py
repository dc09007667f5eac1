import gzip
import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import cells
from textloom.streaming import ingest


def test_ingest_takes_each_event_once(spark, tmp_path):
    schema = "event_id long, ts timestamp, kind string"
    rows = lambda ids: spark.createDataFrame([(i, "k") for i in ids], "event_id long, kind string").select("event_id", F.timestamp_seconds(F.col("event_id") * 60).alias("ts"), "kind")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows([1, 2, 2, 3]).coalesce(1).write.mode("append").parquet(source)

    def run():
        events = ingest.first_deliveries(ingest.read_events(spark, source, schema), "event_id", "ts", "1 hour")
        ingest.append_until_done(events, out, str(tmp_path / "state"))

    run()
    rows([3, 4]).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_windows(spark):
    df = spark.createDataFrame([(0, "a"), (59, "a"), (60, "a")], "s long, kind string").select(F.timestamp_seconds("s").alias("ts"), "kind")
    assert sorted(r.n for r in ingest.windowed_counts(df, "ts", ["kind"], "1 minute", "1 minute").collect()) == [1, 2]


def raw(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "at") as f:  # one member for each append
        f.writelines(json.dumps(r) + "\n" for r in rows)


def test_raw_cells(spark, tmp_path):
    good = {"id": "https://openalex.org/W1", "year": 2001, "type": "article", "authors": ["a"], "abstract": "x"}
    raw(tmp_path / "ai" / "2000.jsonl.gz", [good])
    raw(tmp_path / "ai" / "2000.jsonl.gz", [good | {"id": "https://openalex.org/W2"}])
    raw(tmp_path / "law" / "1990.jsonl.gz", [good])
    out = cells.read_raw_cells(spark, str(tmp_path))
    assert sorted((r.id[-2:], r.field, r.decade) for r in out.collect()) == [("W1", "ai", 2000), ("W1", "law", 1990), ("W2", "ai", 2000)]
    assert cells.read_raw_cells(spark, str(tmp_path), field="law").count() == 1
    for bad in ({"surprise": 1}, {"id": "W3"}):
        raw(tmp_path / "bad" / "2000.jsonl.gz", [good | bad])
        with pytest.raises(Exception, match="unknown keys|bad id"):
            cells.read_raw_cells(spark, str(tmp_path), field="bad").collect()


def test_records_append_once(spark, tmp_path, table):
    path = str(tmp_path / "store")
    for _ in range(2):
        cells.append_records(table("id string, title string", [("a", "x"), ("b", "y")]), path)
    assert cells.read_records(spark, path, "id string, missing boolean").count() == 2
    assert cells.read_records(spark, str(tmp_path / "none"), "id string").count() == 0


def test_builds_keep_earlier_ones(spark, tmp_path, table):
    from textloom import schemas

    row = lambda text: table(schemas.ABSTRACTS, [("https://openalex.org/W1", 2017, 2010, ["ai"], "regular", "article", ["a"], text, [], [], [], None, None)])
    path = str(tmp_path / "corpus")
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    cells.save_build(row("old"), path, "1")
    cells.save_build(row("new"), path, "2")
    with pytest.raises(FileExistsError):
        cells.save_build(row("other"), path, "1")
    assert [cells.load_build(spark, path, b).first().text for b in "12"] == ["old", "new"]
    assert cells.load_build(spark, path, "1", ["ai_2010"]).count() == 1
    with pytest.raises(FileNotFoundError, match="law_1990, x_1"):
        cells.load_build(spark, path, "1", ["x_1", "law_1990"])
    with pytest.raises(ValueError, match="decade"):
        cells.save_build(row("x").withColumn("decade", F.lit(2000).cast("long")), path, "3")


def test_small_files(spark, tmp_path):
    (tmp_path / "w.txt").write_text("one # comment\n\n# all\ntwo\none\n")
    assert sorted(r.word for r in cells.read_word_list(spark, str(tmp_path / "w.txt")).collect()) == ["one", "two"]
    (tmp_path / "t.tsv").write_text('a\tb\n"x\ty\n')
    assert tuple(cells.read_tab_separated(spark, str(tmp_path / "t.tsv")).first()) == ('"x', "y")
    cells.rewrite_text_files(spark, str(tmp_path / "w.txt"), str(tmp_path / "out"), F.upper)
    assert "TWO" in {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    with pytest.raises(ValueError):
        cells.load_patterns(['{"id": "a", "regex": "x", "scope": "tokens"}'] * 2)
