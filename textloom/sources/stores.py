"""Checked stores: staging and decision tables, a cache of documents by their text, linked records, vectors, metrics and a log of runs."""

from __future__ import annotations

import json
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checks
from .cells import read_records

#: Tables that a build derives, by name: their schema.
DERIVED = {
    "glued_words": "word string, left string, right string, works bigint, occurrences bigint, joined bigint, apart bigint, left_alone bigint, opener_rank bigint, reason string, split boolean",
    "split_words": "word string, left string, right string, left_is_word boolean, right_is_word boolean, joined bigint, space bigint, hyphen_space bigint, hyphen bigint, kept_apart boolean, join boolean, join_hyphenated boolean",
    "lower_glued_words": "word string, pattern string, parts array<string>, separators array<string>, joined bigint, apart bigint, uses bigint, capitalised_uses bigint, kept_joined boolean, split boolean",
    "sentences": "work_id string, start bigint, end bigint",
    "sentence_languages": "work_id string, start bigint, end bigint, language string, confidence double",
    "repaired_texts": "work_id string, text string",
    "static_view": "work_id string, tokens array<string>, starts array<bigint>, finite_verbs array<boolean>",
}


def _missing(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def save_table(table: DataFrame, path: str, schema: str, rules: dict[str, str] | None = None, unique: str | None = None) -> None:
    """Write a staging table with exactly the declared columns, after its rows are checked; nothing is written where a rule is broken."""
    fields = [(f.name, f.dataType) for f in table.sparkSession.createDataFrame([], schema).schema.fields]
    if sorted(table.columns) != sorted(n for n, _ in fields):
        raise ValueError(f"columns {sorted(table.columns)} are not {sorted(n for n, _ in fields)}")
    checked = table.select(*[F.col(n).cast(t).alias(n) for n, t in fields])
    checks.check(checked, rules or {}, unique)
    checked.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A staging table under its declared schema, all or some columns; a missing table is an error that names it."""
    try:
        table = spark.read.schema(schema).parquet(path)
    except Exception as error:
        if _missing(error):
            raise FileNotFoundError(f"no table at {path}") from error
        raise
    return table.select(*columns) if columns else table


def save_derived(table: DataFrame, folder: str, name: str) -> None:
    save_table(table, f"{folder}/{name}", DERIVED[name])


def load_derived(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return load_table(spark, f"{folder}/{name}", DERIVED[name], columns)


def with_cached(documents: DataFrame, text: str, path: str, compute, schema: str) -> DataFrame:
    """``documents`` with the columns that ``compute`` makes of a text, from a cache keyed by the text's digest.

    Only texts that the cache doesn't hold are computed, each once, and appended. ``compute``: a table with ``digest`` and the text to
    one with ``digest`` and the columns of ``schema``.
    """
    spark = documents.sparkSession
    keyed = documents.withColumn("digest", F.sha2(text, 256))
    whole = f"digest string, {schema}"
    try:
        cache = spark.read.schema(whole).parquet(path)
    except Exception as error:
        if not _missing(error):
            raise
        cache = spark.createDataFrame([], whole)
    new = keyed.select("digest", text).where("digest is not null").join(cache.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    compute(new).select("digest", *[c for c in cache.columns if c != "digest"]).write.mode("append").parquet(path)
    return keyed.join(spark.read.schema(whole).parquet(path), "digest", "left").drop("digest")


def append_linked(records: DataFrame, path: str, rules: dict[str, str]) -> int:
    """Append linked records of works that the store doesn't hold, all checked before any is written; how many were new."""
    checks.check(records, rules, "work_id")
    done = read_records(records.sparkSession, path, "work_id string")
    new = records.join(done, "work_id", "left_anti")
    n = new.count()
    if n:
        new.write.mode("append").option("compression", "gzip").json(path)
    return n


def record_ids(spark: SparkSession, path: str, field: str = "id") -> DataFrame:
    """Only the ids of a store of JSON records: nothing else is parsed."""
    return read_records(spark, path, f"{field} string")


def list_files(spark: SparkSession, pattern: str, name: str, columns: dict[str, str]) -> DataFrame:
    """(columns, path, bytes) of files whose path ends in the regular expression ``name``, a group for each column (name -> type).

    Only the listing is read, never a file's content.
    """
    try:
        files = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))
    except Exception as error:
        if not _missing(error):
            raise
        files = spark.createDataFrame([], "path string, bytes bigint")
    groups = [F.regexp_extract("path", name + "$", k).cast(kind).alias(c) for k, (c, kind) in enumerate(columns.items(), 1)]
    return files.where(F.col("path").rlike(name + "$")).select(*groups, "path", "bytes")


def list_cells(spark: SparkSession, folder: str) -> DataFrame:
    """(field, decade, path, bytes) of the raw cells."""
    return list_files(spark, f"{folder}/*/*.jsonl.gz", r"/([^/]+)/([0-9]+)\.jsonl\.gz", {"field": "string", "decade": "bigint"})


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    """(field, decade, path, bytes) of the cells that vectors are stored for."""
    return list_files(spark, f"{folder}/field=*/decade=*/*.parquet", r"/field=([^/]+)/decade=([0-9]+)/[^/]+\.parquet", {"field": "string", "decade": "bigint"})


def select_cells(cells: DataFrame, fields: list[str] | None = None, decades: list[int] | None = None) -> DataFrame:
    """The chosen cells; a choice that holds none is an error."""
    chosen = cells
    if fields is not None:
        chosen = chosen.where(F.col("field").isin(fields))
    if decades is not None:
        chosen = chosen.where(F.col("decade").isin(decades))
    if chosen.isEmpty():
        raise ValueError(f"no cell of fields {fields} and decades {decades}")
    return chosen


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors (field, decade, word, vec) by cell, in single precision; only the cells that are written are replaced."""
    narrow = vectors.withColumn("vec", F.col("vec").cast("array<float>"))
    narrow.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("field", "decade").parquet(path)


def load_vectors(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    vectors = spark.read.parquet(path)
    return vectors if field is None else vectors.where(F.col("field") == field)


def missing_cells(counts: DataFrame, models: DataFrame) -> DataFrame:
    """(field, decade) of cells that no vectors are stored for yet."""
    return counts.select("field", "decade").distinct().join(models.select("field", "decade"), ["field", "decade"], "left_anti")


def save_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    """One JSON document with sorted keys; a report's few hundred numbers."""
    text = json.dumps(metrics, sort_keys=True, indent=1)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_metrics(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))  # one document


def record_run(spark: SparkSession, path: str, name: str, parameters: dict, seconds: dict[str, float], rows: dict[str, int]) -> None:
    """Append one run to the log: what ran, with what, how long each stage took and how many rows it made."""
    run = (name, spark.sparkContext.applicationId, json.dumps(parameters, sort_keys=True), seconds, rows)
    schema = "name string, application string, parameters string, seconds map<string,double>, rows map<string,bigint>"
    spark.createDataFrame([run], schema).withColumn("recorded", F.current_timestamp()).coalesce(1).write.mode("append").json(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The log of runs, the earliest first."""
    return read_records(spark, path, "name string, application string, parameters string, seconds map<string,double>, rows map<string,bigint>, recorded timestamp").orderBy("recorded")


def read_sense_lists(path: str) -> dict[str, dict[str, list[str]]]:
    """Senses and their cues by word, from a small TOML file; an unknown kind of cue is an error."""
    with open(path, "rb") as f:
        lists = tomllib.load(f)
    for word, senses in lists.items():
        for sense, cues in senses.items():
            if wrong := [c for c in cues if not re.fullmatch(r"(<<|>>|<|>|!)?[a-z']+", c)]:
                raise ValueError(f"{word}, {sense}: no cues: {wrong}")
    return lists


def read_usages(spark: SparkSession, path: str) -> DataFrame:
    """(lemma, identifier, grouping, context, start, end) of usages in tab-separated files without quoting; ``a:b`` are the target's characters."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    place = F.split("indexes_target_token", ":")
    return raw.select("lemma", "identifier", "grouping", "context", F.get(place, F.lit(0)).cast("int").alias("start"), F.get(place, F.lit(1)).cast("int").alias("end"))


def read_graded_change(spark: SparkSession, path: str) -> DataFrame:
    """(lemma, change) of a tab-separated file; part-of-speech endings of the lemma (``_nn``) go."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return raw.select(F.regexp_replace("lemma", "_[a-z]{2}$", "").alias("lemma"), F.col("change_graded").cast("double").alias("change"))


def rewrite_stage(spark: SparkSession, folder: str, source: str, target: str, change) -> None:
    """Text files ``<folder>/<source stage>/<source>/texts/*.txt`` changed line by line, into partitions of the same source and name below the target stage."""
    lines = spark.read.text(f"{folder}/{source}/*/texts/*.txt").select("value", F.col("_metadata.file_path").alias("path"))
    named = lines.select(change(F.col("value")).alias("value"), F.regexp_extract("path", r"/([^/]+)/texts/[^/]+\.txt$", 1).alias("source"), F.regexp_extract("path", r"/texts/([^/]+)\.txt$", 1).alias("name"))
    named.write.mode("overwrite").partitionBy("source", "name").text(f"{folder}/{target}")
