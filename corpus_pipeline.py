"""A corpus pipeline of four stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import jaccard, line_dedup, packing, toxicity
from textloom.llm.queries import tokenizer_path
from textloom.llm.shared import new_table_path
from textloom.shared import dealt


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts go; rows without doc_id are scored like all others.

    Null and empty texts have the bias as their score; whole texts of any length are scored. Rows are independent, so repeated rows go
    or stay together, and there are no ties. Without labels nothing goes; an empty table stays empty. Other columns stay as they are.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share stay in one document only; n_chars follows the text.

    Every row stays. Null texts stay null, an empty text stays empty, long ones are gone through line by line. The least doc_id keeps a
    line, so ties don't arise; rows that repeat it keep it all. An empty table stays empty; columns of any name stay as they are.
    """
    total, removed = line_dedup.fresh("n_lines", docs), line_dedup.fresh("n_removed", docs)
    out = line_dedup.dedup_lines(docs, n_lines=total, n_removed=removed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates stays; rows without doc_id stay.

    Rows go one by one: of a doc_id with several texts, those whose text is not near any other's stay. Null and empty texts are
    copies of each other, so one of them stays; long texts count whole. Rows that repeat a doc_id and its text stay or go together. An
    empty table stays empty; columns of any name stay as they are.
    """
    found = jaccard.near_classes(docs)
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_text"]), "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets.

    A null or empty text is one end mark, a long one several pieces; repeated rows are packed once each, and ties between pieces of a
    length go by the order of writing. An empty table gives no rows. The result has columns of its own.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: The first stage is a trained model and the last a tokenizer: not for SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole of ``documents``; each reads the Parquet table that the one before wrote.

    An executor that is lost costs the tasks of one stage at most. What the stages state of nulls, long texts, ties, repeated rows, empty
    tables and clashing names holds for the whole.
    """
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        path = new_table_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
