"""Senses by cues around a word, shares and their divergence, and agreement between labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 5


def around(text: Column, start: Column, end: Column, window: int = WINDOW) -> tuple[Column, Column]:
    """Up to ``window`` lower-cased words before and after a place of the text."""
    find = lambda part: F.regexp_extract_all(F.lower(part), F.lit("[a-z']+"), F.lit(0))
    left = find(F.substr(text, F.lit(1), start.cast("int")))
    right = find(F.substr(text, (end + 1).cast("int")))
    n = F.size(left)
    return F.slice(left, F.greatest(n - window + 1, F.lit(1)), F.lit(window)), F.slice(right, F.lit(1), F.lit(window))


def _fires(cues: list[str], left: Column, right: Column) -> Column:
    near = lambda w: F.array_contains(left, w) | F.array_contains(right, w)

    def present(cue: str) -> Column:
        if cue.startswith("<<"):
            return F.coalesce(F.get(left, F.size(left) - 1) == cue[2:], F.lit(False))
        if cue.startswith(">>"):
            return F.coalesce(F.get(right, F.lit(0)) == cue[2:], F.lit(False))
        if cue.startswith("<"):
            return F.array_contains(left, cue[1:])
        if cue.startswith(">"):
            return F.array_contains(right, cue[1:])
        return near(cue)

    some = reduce(lambda a, b: a | b, [present(c) for c in cues if not c.startswith("!")], F.lit(False))
    return reduce(lambda a, b: a & ~b, [near(c[1:]) for c in cues if c.startswith("!")], some)


def cue_sense(cues: dict[str, list[str]], left: Column, right: Column) -> Column:
    """The one sense whose cues stand near, or null where none's or several senses' do.

    Cues: ``word`` on either side, ``<word`` before, ``>word`` after, ``<<word`` and ``>>word`` right beside, ``!word`` forbids.
    """
    fired = F.filter(F.array(*[F.when(_fires(c, left, right), F.lit(s)) for s, c in cues.items()]), lambda s: s.isNotNull())
    return F.when(F.size(fired) == 1, F.get(fired, F.lit(0)))


def out_of_scope(words: list[str], left: Column, right: Column) -> Column:
    return F.arrays_overlap(F.concat(left, right), F.array(*map(F.lit, words)))


def shares(rows: DataFrame, cell: str, label: str) -> DataFrame:
    """(cell, label, n, share), null labels left out."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(cell, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(cell)))


def divergences(distribution: DataFrame, cell: str, label: str) -> DataFrame:
    """(cell_a, cell_b, divergence): Jensen-Shannon in bits between every two cells."""
    labels, cells = distribution.select(label).distinct(), distribution.select(cell).distinct()
    full = cells.crossJoin(labels).join(distribution.select(cell, label, "share"), [cell, label], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))  # cells times labels
    a = full.select(F.col(cell).alias("cell_a"), label, F.col("share").alias("p"))
    b = full.select(F.col(cell).alias("cell_b"), label, F.col("share").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return a.join(b, label).where("cell_a < cell_b").groupBy("cell_a", "cell_b").agg(F.sum((term(F.col("p")) + term(F.col("q"))) / 2).alias("divergence"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, share), each true label's row summing to 1; a label never seen as true has an identity row."""
    known = rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    counts = known.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    seen = counts.select("truth", "predicted", (F.col("n") / F.sum("n").over(Window.partitionBy("truth"))).alias("share"))
    unseen = counts.select(F.col("predicted").alias("truth")).distinct().join(counts.select("truth").distinct(), "truth", "left_anti")
    return seen.union(unseen.select("truth", F.col("truth").alias("predicted"), F.lit(1.0).alias("share")))


def adjusted_shares(matrix: DataFrame, observed: DataFrame) -> DataFrame:
    """(label, share): the true shares that best give the observed ones through the confusion matrix, not negative, sum 1.

    Labels are few, so the matrix is one group. Non-negative least squares by projected coordinate descent.
    """
    import numpy as np
    import pandas as pd

    rows = matrix.select(F.col("truth").alias("t"), F.col("predicted").alias("label"), "share").union(observed.select(F.lit(None), "label", "share"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        labels = sorted(set(group["label"]) | set(group["t"].dropna()))
        index = {x: i for i, x in enumerate(labels)}
        m, y = np.zeros((len(labels), len(labels))), np.zeros(len(labels))
        for t, label, share in group.itertuples(index=False):
            if t is None or t != t:
                y[index[label]] = share
            else:
                m[index[label], index[t]] = share
        x, g = np.zeros(len(labels)), m.T @ m
        for _ in range(2000):
            for i in range(len(labels)):
                if g[i, i] > 0:
                    x[i] = max(0.0, x[i] - (g[i] @ x - m[:, i] @ y) / g[i, i])
        return pd.DataFrame({"label": labels, "share": x / x.sum() if x.sum() > 0 else y})

    return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda group: solve(group.drop(columns="one")), schema="label string, share double")


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: items, exact share, Cohen's kappa and the adjusted Rand index of two labellings, from their contingency table."""
    table = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    cells = table.agg(F.sum("n").alias("items"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"), F.sum(pairs(F.col("n"))).alias("together"))
    by_a, by_b = (table.groupBy(s).agg(F.sum("n").alias(f"n_{s}")) for s in "ab")
    of_a, of_b = by_a.agg(F.sum(pairs(F.col("n_a"))).alias("pa")), by_b.agg(F.sum(pairs(F.col("n_b"))).alias("pb"))
    chance = by_a.join(by_b, by_a["a"] == by_b["b"]).agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("chance"))
    one = cells.crossJoin(of_a).crossJoin(of_b).crossJoin(chance)  # single rows
    n, expected = F.col("items"), F.col("pa") * F.col("pb") / pairs(F.col("items"))
    exact, by_chance = F.col("same") / n, F.col("chance") / (n * n)
    return one.select("items", exact.alias("exact"), F.try_divide(exact - by_chance, 1 - by_chance).alias("kappa"), F.try_divide(F.col("together") - expected, (F.col("pa") + F.col("pb")) / 2 - expected).alias("adjusted_rand"))


def sample_occurrences(works: DataFrame, key: str, cell: str, text: str, word: str, cap: int, seed: str = "0") -> DataFrame:
    """For each cell the first ``cap`` works, by a seeded hash, that hold the word, with the sentence of its first place."""
    holds = works.where(F.lower(F.col(text)).rlike(rf"(^|[^\p{{L}}]){word}([^\p{{L}}]|$)"))
    order = Window.partitionBy(cell).orderBy(F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256))
    first = F.regexp_extract(text, rf"(?i)([^.!?\n]*(?<!\p{{L}}){word}(?!\p{{L}})[^.!?\n]*)", 1)
    return holds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select(cell, key, F.trim(first).alias("context"))


def drop_shared(works: DataFrame, key: str, field: str, decade: str) -> DataFrame:
    """Works that stand in one field only in their decade."""
    alone = works.groupBy(key, decade).agg(F.countDistinct(field).alias("fields")).where("fields = 1")
    return works.join(alone.select(key, decade), [key, decade], "left_semi")


def chunk_budget(chunks: DataFrame, key: str, size: str, group: str, budget: int) -> DataFrame:
    """Chunks of each group in hash order, taken while the total before is below the budget.

    Totals of 256 buckets by the hash's first byte come first, so a group is sorted in parts, and only buckets that the budget reaches are.
    """
    digest = F.sha2(F.col(key).cast("string"), 256)
    cut = chunks.withColumns({"_digest": digest, "_bucket": F.substring(digest, 1, 2)})
    totals = cut.groupBy(group, "_bucket").agg(F.sum(size).alias("_total"))
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows a group
    starts = totals.select(group, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start")).where(F.col("_start") < budget)
    order = Window.partitionBy(group, "_bucket").orderBy("_digest").rowsBetween(Window.unboundedPreceding, -1)
    reached = cut.join(starts, [group, "_bucket"]).withColumn("before", F.col("_start") + F.coalesce(F.sum(size).over(order), F.lit(0)))
    return reached.where(F.col("before") < budget).drop("_digest", "_bucket", "_start")


def context_of(text: Column, word: str, most: int = 100) -> Column:
    """The sentence of a word's first place, of at most ``most`` words around it."""
    sentence = F.trim(F.regexp_extract(text, rf"(?i)([^.!?\n]*(?<!\p{{L}}){word}(?!\p{{L}})[^.!?\n]*)", 1))
    words = F.split(sentence, " +")
    hits = F.transform(words, lambda w: F.lower(w).rlike(rf"(^|[^\p{{L}}]){word}([^\p{{L}}]|$)"))
    at = F.array_position(hits, True).cast("int")
    first = F.greatest(F.lit(1), F.least(at - most // 2, F.size(words) - most + 1))
    return F.array_join(F.slice(words, first, F.lit(most)), " ")


def sample_many(works: DataFrame, key: str, cell: str, text: str, words: DataFrame, cap: int, seed: str = "0") -> DataFrame:
    """(word, cell, key): for every word and cell the first ``cap`` works by a seeded hash; one pass over the texts for all words.

    Texts become their distinct words, which meet the list; only pairs of a listed word and a work are ranked.
    """
    tokens = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0)))).alias("word")
    found = works.select(key, cell, tokens).join(words.select("word").distinct(), "word", "left_semi")
    order = Window.partitionBy("word", cell).orderBy(F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select("word", cell, key)


def leave_one_cue_out(rows: DataFrame, cues: dict[str, list[str]], left: str, right: str) -> DataFrame:
    """(sense, cue, places, changed): how many places have a sense, and how many another or none when one cue is left out; one pass."""
    whole = cue_sense(cues, F.col(left), F.col(right))
    variants = [
        F.struct(F.lit(s).alias("sense"), F.lit(c).alias("cue"), cue_sense({k: [x for x in v if (k, x) != (s, c)] for k, v in cues.items()}, F.col(left), F.col(right)).alias("now"))
        for s, cs in cues.items()
        for c in cs
    ]
    each = rows.select(whole.alias("was"), F.explode(F.array(*variants)).alias("v"))
    return each.groupBy("v.sense", "v.cue").agg(F.count("was").alias("places"), F.sum((~F.col("was").eqNullSafe(F.col("v.now"))).cast("long")).alias("changed"))


def spearman(rows: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, items, rho): the correlation of average ranks of two values, nulls left out."""
    by = by or []
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2
    ranked = known.select(*by, rank(a).alias("ra"), rank(b).alias("rb"))
    return ranked.groupBy(*by).agg(F.count("*").alias("items"), F.corr("ra", "rb").alias("rho"))


def repeat_consistency(rows: DataFrame, key: str, label: str) -> DataFrame:
    """One row: items labelled more than once, and the share of them whose labels all agree."""
    each = rows.where(F.col(label).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(label).alias("kinds")).where("n > 1")
    return each.agg(F.count("*").alias("items"), F.avg((F.col("kinds") == 1).cast("double")).alias("consistent"))


def sqrt_balanced(rows: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """Rows of each label in proportion to the square root of its count, ``most`` of the most frequent; the first by hash."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    largest = sizes.agg(F.max("_n").alias("_largest"))
    limit = F.greatest(F.lit(1), F.floor(F.lit(most) * F.sqrt(F.col("_n") / F.col("_largest"))))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(label).orderBy(F.sha2(F.col(key).cast("string"), 256))))
    limits = sizes.crossJoin(F.broadcast(largest)).select(label, limit.alias("_limit"))  # one row
    return placed.join(limits, label).where(F.col("_place") <= F.col("_limit")).drop("_place", "_limit")
