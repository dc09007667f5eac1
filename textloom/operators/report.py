"""Sections of the corpus report, metrics, and the comparison of two builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise as checkpoint
from .quantiles import quantiles


def totals(works: DataFrame) -> DataFrame:
    kept = F.sum(F.col("dropped_reason").isNull().cast("long"))
    return works.agg(F.count("*").alias("works"), kept.alias("kept"), (F.count("*") - kept).alias("dropped"))


def dropped_by(works: DataFrame, by: str, reasons: list[str]) -> DataFrame:
    """Drops of each reason, one column each, and their sum. Given reasons save the pass that a pivot needs to find them."""
    counted = works.where("dropped_reason is not null").groupBy(by).pivot("dropped_reason", reasons).count().na.fill(0)
    return counted.withColumn("total", sum((F.col(r) for r in reasons), F.lit(0).cast("bigint")))


def removal_counts(works: DataFrame) -> DataFrame:
    """Of each reason the ranges, their characters and the works that have one."""
    rows = works.select("work", F.explode("removals").alias("r"))
    return rows.groupBy("r.reason").agg(F.count("*").alias("ranges"), F.sum(F.col("r.end") - F.col("r.start")).alias("characters"), F.countDistinct("work").alias("works"))


def top_templates(sentences: DataFrame, n: int = 30) -> DataFrame:
    """The sentences that most works share: a bounded report, by a top-n that keeps n rows for each task."""
    return sentences.orderBy(F.desc("works"), "masked").limit(n)


def flags_by(works: DataFrame, by: str, flags: list[str]) -> DataFrame:
    return works.select(by, F.explode("flags").alias("flag")).groupBy(by).pivot("flag", flags).count().na.fill(0)


def outcome_rates(works: DataFrame, by: str) -> DataFrame:
    kept = F.sum(F.col("dropped_reason").isNull().cast("long"))
    return works.groupBy(by).agg(F.count("*").alias("works"), kept.alias("kept"), F.round(100 * kept / F.count("*"), 1).alias("kept_percent"))


def outcomes_with_example(works: DataFrame, by: str, text: str) -> DataFrame:
    """Works and kept works of each group, with the length of the first kept work's text."""
    kept = F.col("dropped_reason").isNull()
    return works.groupBy(by).agg(F.count("*").alias("works"), F.sum(kept.cast("long")).alias("kept"), F.min_by(F.length(text).cast("long"), F.when(kept, F.col("work"))).alias("first_length"), F.min(F.when(kept, F.col("work"))).alias("first_kept"))


def duplicate_relations(works: DataFrame, same: dict[str, Column]) -> DataFrame:
    """How the near-duplicates relate to the works that they repeat; ``same`` compares columns of a and b."""
    a = works.where("duplicate_of is not null").alias("a")
    joined = a.join(works.alias("b"), F.col("a.duplicate_of") == F.col("b.work"))
    return joined.agg(F.count("*").alias("duplicates"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in same.items()])


def short_works(works: DataFrame, words: Column, least: int) -> DataFrame:
    n = checkpoint(works.where("dropped_reason is null").select(words.alias("n")))
    short = F.col("n") < least
    counted = n.agg(F.count("*").alias("kept"), F.sum(short.cast("long")).alias("short"), F.round(F.avg("n"), 4).alias("mean_words"))
    median = quantiles(n, [], "n", [0.5]).agg(F.max("value").alias("median_words"))
    return counted.crossJoin(median).select("kept", "short", "median_words", "mean_words")  # one row each


def metrics(works: DataFrame, reasons: str = "dropped_reason") -> DataFrame:
    """(metric, value): totals, drops, removals and flags stacked as flattened names; one aggregation over exploded keys."""
    names = F.concat(
        F.array(F.lit("works"), F.concat(F.lit("outcome."), F.coalesce(reasons, F.lit("kept")))),
        F.transform("flags", lambda f: F.concat(F.lit("flags."), f)),
        F.transform("removals", lambda r: F.concat(F.lit("removals."), r["reason"])),
    )
    return works.select(F.explode(names).alias("metric")).groupBy("metric").agg(F.count("*").alias("value"))


def compare_metrics(before: DataFrame, now: DataFrame) -> DataFrame:
    b, n = before.withColumnRenamed("value", "before"), now.withColumnRenamed("value", "now")
    both = b.join(n, "metric", "full").select("metric", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("now", F.lit(0)).alias("now"))
    return both.withColumn("change", F.col("now") - F.col("before")).where("change <> 0")


def transitions(before: DataFrame, now: DataFrame) -> DataFrame:
    """(before, now, works) of works whose outcome differs, works of one build alone as absent."""
    outcome = lambda df, n: df.select("work", F.coalesce("dropped_reason", F.lit("kept")).alias(n))
    both = outcome(before, "before").join(outcome(now, "now"), "work", "full").na.fill("absent")
    return both.where("before <> now").groupBy("before", "now").agg(F.count("*").alias("works"))


def removal_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(reason, before, now, new, no_longer): ranges of both builds, by exact range."""
    ranges = lambda df: df.select("work", F.explode("removals").alias("r")).select("work", "r.start", "r.end", "r.reason").distinct()
    a, b = ranges(before).withColumn("in_before", F.lit(1)), ranges(now).withColumn("in_now", F.lit(1))
    both = a.join(b, ["work", "start", "end", "reason"], "full").na.fill(0, ["in_before", "in_now"])
    return both.groupBy("reason").agg(F.sum("in_before").alias("before"), F.sum("in_now").alias("now"), F.sum((F.col("in_now") > F.col("in_before")).cast("long")).alias("new"), F.sum((F.col("in_before") > F.col("in_now")).cast("long")).alias("no_longer"))


def changed_rows(before: DataFrame, now: DataFrame, key: list[str], column: str) -> DataFrame:
    """Rows of both builds whose value differs, null being a value."""
    a = before.select(*key, F.col(column).alias("before"))
    b = now.select(*key, F.col(column).alias("now"))
    return a.join(b, key).where(~F.col("before").eqNullSafe(F.col("now")))


def sample_per_group(rows: DataFrame, group: str, key: str, n: int = 15) -> DataFrame:
    """The first ``n`` of each group by hash: a bounded preview for readers."""
    order = Window.partitionBy(group).orderBy(F.sha2(F.col(key).cast("string"), 256))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def first_difference(before: str, now: str, around: int = 40) -> str:
    """Where two texts part, with some characters around it."""
    k = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
    cut = lambda t: t[max(0, k - around) : k + around]
    return f"{cut(before)!r} -> {cut(now)!r}"


def markdown(title: str, rows: DataFrame, most: int | None = None) -> str:
    """A report's table as Markdown, written by the driver; whole unless ``most`` rows are asked for, which the text then says."""
    shown = rows.collect() if most is None else rows.limit(most + 1).collect()  # a report section: aggregated rows
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(map(str, r)) + " |" for r in (shown if most is None else shown[:most])]
    return "\n".join(lines + ([f"\nOnly the first {most} rows are shown."] if most is not None and len(shown) > most else [])) + "\n"
