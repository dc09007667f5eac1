"""Raw cells, staging tables, builds of the corpus, and small curated files."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checks, schemas
from . import revisions


def read_raw_cells(spark: SparkSession, folder: str, field: str = "*", decade: str = "*") -> DataFrame:
    """``<field>/<decade>.jsonl.gz`` as one table with the field and decade of each file; unknown keys and malformed ids raise.

    The glob prunes files by field and decade before anything is read.
    """
    path = f"{folder}/{field}/{decade}.jsonl.gz"
    text = spark.read.text(path).where("trim(value) <> ''").select("value", F.input_file_name().alias("file"))
    known = {c.split()[0] for c in schemas.RAW_WORK.split(", ")}
    keys = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, sorted(known))))
    row = F.from_json("value", schemas.RAW_WORK, {"mode": "FAILFAST"})
    good = row["id"].rlike(r"^https://openalex\.org/W[0-9]+$")
    checked = F.when(F.size(keys) > 0, F.raise_error(F.concat(F.lit("unknown keys in "), "file"))).when(~F.coalesce(good, F.lit(False)), F.raise_error(F.concat(F.lit("bad id in "), "file"))).otherwise(row)
    return text.select(checked.alias("row"), "file").select(
        "row.*",
        F.regexp_extract("file", r"([^/]+)/[^/]+\.jsonl\.gz$", 1).alias("field"),
        F.regexp_extract("file", r"([0-9]+)\.jsonl\.gz$", 1).cast("long").alias("decade"),
    )


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines under a declared schema: missing fields are null, others are left out; no file, no rows."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def append_records(df: DataFrame, path: str) -> None:
    """Append only records whose id the store doesn't hold yet, so a broken run can be repeated."""
    done = read_records(df.sparkSession, path, "id string")
    df.join(done, "id", "left_anti").write.mode("append").option("compression", "gzip").json(path)


def builds(spark: SparkSession, path: str) -> set[str]:
    """The builds that a corpus folder holds; none where there is no folder."""
    return {m["build"] for m in revisions.log(spark, path)}


def save_build(abstracts: DataFrame, path: str, build_id: str) -> None:
    """Commit one build of the corpus, by part. A build that is there is never changed, and parts that another build has are shared with it."""
    checks.check(abstracts, checks.ABSTRACT_RULES, "work_id")
    revisions.commit(abstracts.withColumn("part", F.concat_ws("_", F.array_min("fields"), "decade")), path, build_id, "part")


def load_build(spark: SparkSession, path: str, build_id: str, parts: list[str] | None = None) -> DataFrame:
    """The corpus as of one build, all or named parts; parts that are missing are all named in the error."""
    return revisions.read(spark, path, build_id, parts).drop("part")


def read_tab_separated(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with a header and no quoting."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One word on a line; what follows ``#`` is a comment."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("word")).where("word <> ''").distinct()


def rewrite_text_files(spark: SparkSession, source: str, target: str, change) -> None:
    """Lines of text files changed one by one by a column function."""
    spark.read.text(source).select(change(F.col("value")).alias("value")).write.mode("overwrite").text(target)


def load_patterns(lines: list[str]) -> list[dict]:
    """Curated cleaning patterns, one JSON object on a line: each regex must compile, each label be known once by id."""
    patterns = [json.loads(x) for x in lines if x.strip()]
    for p in patterns:
        re.compile(p["regex"])
        if p["scope"] not in ("tokens", "rest_of_sentence", "abstract", "abstract_or_sentence"):
            raise ValueError(f"unknown scope {p['scope']}")
    if len({p["id"] for p in patterns}) < len(patterns):
        raise ValueError("an id stands twice")
    return patterns
