"""Corpus-level rules over abstracts: ranges to remove, flags to set, works to drop. Texts are never edited."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import not_first
from .duplicates import checkpoint
from .resample import places

TEMPLATE_SHARE = 0.5


def sentence_rows(works: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per sentence: key, start, end, sentence."""
    return works.select(key, F.explode(T.sentence_spans(F.col(text))).alias("s")).select(key, "s.*")


def template_sentences(sentences: DataFrame, key: str, min_works: int) -> DataFrame:
    """Masked sentences that at least ``min_works`` distinct works share, with how many do."""
    return (
        sentences.select(key, T.masked(F.col("sentence")).alias("masked"))
        .groupBy("masked")
        .agg(F.countDistinct(key).alias("works"))
        .where(F.col("works") >= min_works)
    )


def mark_template_rows(sentences: DataFrame, key: str, min_works: int) -> DataFrame:
    """Each sentence row with ``is_template``."""
    shared = template_sentences(sentences, key, min_works).select("masked", F.lit(True).alias("is_template"))
    return sentences.withColumn("masked", T.masked(F.col("sentence"))).join(shared, "masked", "left").withColumn("is_template", F.coalesce("is_template", F.lit(False)))


def shares_of_templates(marked: DataFrame, key: str) -> DataFrame:
    length = F.length("sentence")
    share = F.sum(F.when(F.col("is_template"), length).otherwise(0)) / F.sum(length)
    return marked.groupBy(key).agg(share.alias("share")).withColumn("is_dropped", F.col("share") > TEMPLATE_SHARE)


def template_shares(sentences: DataFrame, key: str, min_works: int) -> DataFrame:
    """The share of each work's sentence characters that templates hold, and whether the work goes."""
    return shares_of_templates(mark_template_rows(sentences, key, min_works), key)


def repeated_sentences(sentences: DataFrame, key: str) -> DataFrame:
    """Rows of a sentence that the same work had before."""
    order = Window.partitionBy(key, "sentence").orderBy("start")
    return sentences.withColumn("copy", F.row_number().over(order)).where("copy > 1")


def add_removals(works: DataFrame, ranges: DataFrame, key: str, reason: str) -> DataFrame:
    """Ranges (key, start, end) that no removal has yet, whatever its reason, join the sorted removals."""
    there = works.select(key, F.explode("removals").alias("r")).select(key, "r.start", "r.end")
    added = (
        ranges.select(key, "start", "end")
        .distinct()
        .join(there, [key, "start", "end"], "left_anti")
        .groupBy(key)
        .agg(F.collect_list(F.struct("start", "end", F.lit(reason).alias("reason"))).alias("added"))
    )
    both = F.array_sort(F.concat("removals", F.coalesce("added", F.array().cast(added.schema["added"].dataType))))
    return works.join(added, key, "left").withColumn("removals", both).drop("added")


def mark_dropped(works: DataFrame, ids: DataFrame, key: str, reason: str) -> DataFrame:
    """The first reason stays."""
    hit = ids.select(key, F.lit(reason).alias("_reason")).distinct()
    return works.join(hit, key, "left").withColumn("dropped_reason", F.coalesce("dropped_reason", "_reason")).drop("_reason")


def add_flag(works: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    hit = ids.select(key, F.lit(flag).alias("_flag")).distinct()
    return works.join(hit, key, "left").withColumn("flags", F.when(F.col("_flag").isNotNull(), F.concat("flags", F.array("_flag"))).otherwise(F.col("flags"))).drop("_flag")


def mark_templates(works: DataFrame, key: str, min_works: int) -> DataFrame:
    """The template rule as the corpus build applies it, on works not dropped yet."""
    sentences = checkpoint(sentence_rows(works.where("dropped_reason is null"), key))  # three passes read it
    marked = mark_template_rows(sentences, key, min_works)
    out = add_removals(works, marked.where("is_template"), key, "template_sentence")
    return mark_dropped(out, shares_of_templates(marked, key).where("is_dropped"), key, "template")


def mark_truncated(works: DataFrame, key: str) -> DataFrame:
    return add_flag(works, works.where(T.ends_mid_sentence(F.col("text"), F.col("removals"))), key, "truncated")


def exact_duplicates(works: DataFrame, key: str, cell: list[str], text: Column) -> DataFrame:
    """Rows whose normalised text an earlier row of the cell has; by hash, so that texts don't move. ``key`` names a row once."""
    return not_first(works.withColumn("digest", F.sha2(text, 256)), [*cell, "digest"], [key], "copy").where("copy").drop("copy")


def cap_single_authors(works: DataFrame, key: str, author: str, cell: list[str], max_share: float, floor: int) -> DataFrame:
    """Works over an author's limit in a cell, where each work has one author: the first by hash of the id stay."""
    order = Window.partitionBy(*cell, author).orderBy(F.sha2(F.col(key).cast("string"), 256))
    sizes = works.groupBy(*cell).agg(F.greatest(F.lit(floor), F.floor(F.lit(max_share) * F.count("*"))).alias("author_limit"))
    return works.join(sizes, cell).withColumn("place", F.row_number().over(order)).where("place > author_limit")


def cap_authors(works: DataFrame, key: str, authors: str, cell: list[str], max_share: float, floor: int) -> DataFrame:
    """The same for works with several authors: the most frequent go first, and a drop lowers co-authors' counts.

    Greedy within each cell; cells don't depend on each other, nor do works without an author over the limit, which stay in the JVM. What
    goes to Python are the ids, authors and ranks of a cell's other works, at most ``MOST_GROUP``; larger cells are settled in rounds.
    """
    sizes = works.groupBy(*cell).agg(F.greatest(F.lit(floor), F.floor(F.lit(max_share) * F.count("*"))).alias("author_limit"))
    written = works.select(*cell, key, F.explode(F.array_distinct(authors)).alias("author"))
    over = written.groupBy(*cell, "author").count().join(sizes, cell).where("count > author_limit").select(*cell, "author")
    touched = written.join(over, [*cell, "author"], "left_semi").select(*cell, key).distinct()
    rank = F.sha2(F.col(key).cast("string"), 256).alias("rank")
    ranked = works.join(touched, [*cell, key], "left_semi").join(sizes, cell).select(*cell, key, authors, "author_limit", rank)

    rows = ranked.groupBy(*cell).agg(F.count("*").alias("_n"), F.sum(F.size(authors)).alias("_written"))
    large = checkpoint(rows.where(F.greatest("_n", "_written") > MOST_GROUP).select(*cell))
    small = ranked.join(large, cell, "left_anti")

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        limit = int(group["author_limit"].iloc[0])
        order = group.sort_values(["rank", key])
        by_author: dict = {}
        for work, names in zip(order[key], order[authors]):
            for name in set(names):
                by_author.setdefault(name, []).append(work)
        gone: set = set()
        for name in sorted(by_author, key=lambda a: (-len(by_author[a]), a)):
            if len(by_author[name]) <= limit:
                break
            gone.update([w for w in by_author[name] if w not in gone][limit:])
        return pd.DataFrame({key: sorted(gone)}, dtype=group[key].dtype)

    gone = small.groupBy(*cell).applyInPandas(greedy, f"{key} {dict(works.dtypes)[key]}")
    if not large.isEmpty():
        gone = gone.union(_capped_in_rounds(ranked.join(large, cell, "left_semi"), key, authors, cell))
    return gone.distinct()


#: Works, or authors of works, of a cell that one task settles; larger cells are settled in rounds over many tasks.
MOST_GROUP = 200_000


def _capped_in_rounds(ranked: DataFrame, key: str, authors: str, cell: list[str], most_rounds: int = 10_000) -> DataFrame:
    """The works that go, of cells of any size: in each round, all authors are settled whose works no unsettled author before them shares.

    Authors settled in one round share no work, so each keeps the first of its works that are left, as if they went one after the other. Rounds follow
    the longest chain of authors that share works.
    """
    written = ranked.select(*cell, key, "rank", "author_limit", F.explode(F.array_distinct(authors)).alias("author"))
    counts = written.groupBy(*cell, "author").agg(F.count("*").alias("_count"))
    over = written.join(counts, [*cell, "author"]).where("_count > author_limit").withColumn("turn", F.struct((-F.col("_count")).alias("less"), "author"))
    number = F.conv(F.substring("rank", 1, 8), 16, 10).cast("bigint").alias("number")
    left = checkpoint(over.select(*cell, key, "author", "author_limit", "turn", number, F.struct("rank", F.col(key).alias("k")).alias("order")))
    gone = None
    for _ in range(most_rounds):
        first = left.groupBy(*cell, key).agg(F.min("turn").alias("_first"))
        ready = left.join(first, [*cell, key]).groupBy(*cell, "author").agg(F.bool_and(F.col("turn") == F.col("_first")).alias("_ready")).where("_ready").drop("_ready")
        mine = checkpoint(left.join(ready, [*cell, "author"], "left_semi"))
        lost = checkpoint(places(mine, [*cell, "author"], "number", "order").where("place > author_limit").select(*cell, key).distinct())
        gone = checkpoint(lost if gone is None else gone.union(lost))
        left = checkpoint(left.join(ready, [*cell, "author"], "left_anti").join(lost, [*cell, key], "left_anti"))
        if left.isEmpty():
            return gone.select(key)
    raise RuntimeError(f"authors are left after {most_rounds} rounds")


def merge_cells(rows: DataFrame, key: str, field: str, order: list[str], attributes: list[str]) -> DataFrame:
    """One row per work: the attributes of its first row, and its fields, sorted and distinct."""
    first = F.min_by(F.struct(*attributes), F.struct(*order))
    return rows.groupBy(key).agg(first.alias("_first"), F.array_sort(F.collect_set(field)).alias("fields")).select(key, "_first.*", "fields")
