"""What cells hold: documents, tokens and target words, by cell and by decade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .drift import reliable_transitions


def count_cells(lines: DataFrame, cell: list[str], tokens: str) -> DataFrame:
    """(cell, documents, tokens): a line is a document."""
    return lines.groupBy(*cell).agg(F.count("*").alias("documents"), F.sum(F.size(tokens)).cast("bigint").alias("tokens"))


def count_targets(lines: DataFrame, cell: list[str], tokens: str, targets: list[str]) -> DataFrame:
    """(cell, target, n) for every cell and target, 0 where it doesn't occur. Tokens meet the short list inside their line."""
    wanted = F.array(*map(F.lit, targets))
    hits = lines.select(*cell, F.explode_outer(F.filter(tokens, lambda w: F.array_contains(wanted, w))).alias("target"))
    found = hits.where("target is not null").groupBy(*cell, "target").agg(F.count("*").alias("n"))
    every = lines.select(*cell).distinct().withColumn("target", F.explode(wanted))  # cells times targets
    return every.join(found, [*cell, "target"], "left").na.fill(0, ["n"])


def merge_by_decade(counts: DataFrame, source: str, decade: str, keys: list[str], values: list[str], left_out: str) -> DataFrame:
    """Sums over the sources of each decade, but for the layer that repeats the others' texts."""
    return counts.where(F.col(source) != left_out).groupBy(*keys, decade).agg(*[F.sum(v).alias(v) for v in values])


def audit_targets(lines: DataFrame, source: str, decade: str, tokens: str, targets: list[str], left_out: str, least: int) -> DataFrame:
    """(target, n, decades, transitions): how often a target occurs, in how many decades, and in how many neighbouring pairs often enough."""
    merged = merge_by_decade(count_targets(lines, [source, decade], tokens, targets), source, decade, ["target"], ["n"], left_out)
    pairs = reliable_transitions(merged, "target", decade, "n", least)
    totals = merged.groupBy("target").agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("decades"))
    return totals.join(pairs, "target")
