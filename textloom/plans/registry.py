"""Queries by name, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import dealt

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


#: Tables of texts, whose rows take long.
TEXTS = ("documents", "pages")


class Tables:
    """The Parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return dealt(table) if name in TEXTS else table


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a name."""

    def add(plan):
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return plan

    return add


#: Parts of SQL that several queries share.
SENTENCES = """
  SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '([.!?])[ \n]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS sentence
  FROM documents
"""
WORDS = "list_filter(string_split_regex(lower(text), '[ \n]+'), lambda w: w <> '')"
