"""Versions of a cell, bootstrap and permutation draws by hash, and the verdicts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import in_order


def merge_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """Overlapping or touching ranges (key, start, end) as one."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def kept_segments(tokens: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """(key, segment, first, tokens): runs of tokens outside all ranges, a range ending the run it stands in.

    ``tokens``: key, at, start, end. Ranges are arrays for each key, so containment is a lambda and no range join.
    """
    spans = ranges.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    joined = tokens.join(spans, key, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    inside = F.exists("cuts", lambda r: (F.col("start") < r["end"]) & (F.col("end") > r["start"]))
    passed = F.size(F.filter("cuts", lambda r: r["end"] <= F.col("start")))
    return joined.where(~inside).groupBy(key, passed.alias("segment")).agg(F.min("at").alias("first"), F.count("*").alias("tokens"))


def hash_number(*parts: Column) -> Column:
    """A number below 2**32 that depends on all parts: the first eight hexadecimal digits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("bigint")


#: Buckets that ``places`` cuts each group into.
BUCKETS = 256


def places(rows: DataFrame, group: list[str], number: str, key: str, name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in their group by (number, key); ``number`` is below 2**32.

    A group is cut into 256 buckets by the first bits of the number, each sorted on its own; how many rows the buckets before have makes
    a place of the whole group. So a group that is a whole table is no single task.
    """
    cut = rows.withColumn("_bucket", F.shiftrightunsigned(F.col(number).cast("bigint"), 24))
    counts = cut.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows a group
    starts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(number, key))
    return cut.withColumn("_within", within).join(starts, [*group, "_bucket"]).withColumn(name, F.col("_start") + F.col("_within")).drop("_bucket", "_start", "_within")


def bootstrap(works: DataFrame, key: str, cell: str, replicates: int) -> DataFrame:
    """(cell, replicate, key, times): n draws with replacement in each cell and replicate.

    Draw i of a replicate takes the row whose place in the cell is hash(cell, replicate, i) mod n.
    """
    placed = in_order(works.select(cell, key), [cell], [key], "_place", "n").select(cell, key, (F.col("_place") - 1).alias("place"), "n")
    draws = placed.select(cell, "place", "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = draws.select(cell, "replicate", F.pmod(hash_number(F.col(cell), F.col("replicate"), F.col("place")), F.col("n")).alias("place"))
    counted = drawn.groupBy(cell, "replicate", "place").agg(F.count("*").alias("times"))
    return counted.join(placed.drop("n"), [cell, "place"]).select(cell, "replicate", key, "times")


def permutation_null(rows: DataFrame, key: str, in_first: Column, value: Column, replicates: int) -> DataFrame:
    """(replicate, gap): the difference of two groups' means; replicate 0 as observed, others with the labels dealt anew by hash.

    A replicate orders all rows by hash and calls as many first as there are; per replicate, a threshold on the
    hash would only be near, so the rank decides.
    """
    base = rows.select(key, in_first.alias("f"), value.alias("v"))
    observed = base.agg((F.avg(F.when(F.col("f"), F.col("v"))) - F.avg(F.when(~F.col("f"), F.col("v")))).alias("gap")).select(F.lit(0).alias("replicate"), "gap")
    n_first = base.agg(F.sum(F.col("f").cast("long")).alias("n_first"))
    dealt = base.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_h", hash_number(F.col("replicate"), F.col(key)))
    labelled = places(dealt, ["replicate"], "_h", key).crossJoin(F.broadcast(n_first))  # one row
    first = F.col("place") <= F.col("n_first")
    nulls = labelled.groupBy("replicate").agg((F.avg(F.when(first, F.col("v"))) - F.avg(F.when(~first, F.col("v")))).alias("gap"))
    return observed.union(nulls)


def rank_test(gaps: DataFrame) -> DataFrame:
    """p = (1 + replicates at least as far from 0 as the observed gap) / (1 + replicates)."""
    observed = gaps.where("replicate = 0").select(F.abs("gap").alias("observed"))
    return gaps.where("replicate > 0").crossJoin(F.broadcast(observed)).agg(((1 + F.sum((F.abs("gap") >= F.col("observed")).cast("long"))) / (1 + F.count("*"))).alias("p"))


def deciles(rows: DataFrame, key: str, length: str) -> DataFrame:
    """``rows`` with ``decile`` by (length, key): ten groups of equal size, the first ones larger by one where there is a rest.

    Ranks come from the counts of each length, which is an aggregate, and from the order within a length.
    """
    counts = rows.groupBy(length).agg(F.count("*").alias("_n"))
    order = Window.orderBy(length)  # one row for each length that occurs
    starts = counts.select(length, (F.sum("_n").over(order) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = rows.withColumn("_within", F.row_number().over(Window.partitionBy(length).orderBy(key)) - 1).join(starts, length)
    rank, size, rest = F.col("_start") + F.col("_within"), F.floor(F.col("_all") / 10), F.col("_all") % 10
    large = rest * (size + 1)
    decile = F.when(rank < large, F.floor(rank / (size + 1))).otherwise(rest + F.floor(F.try_divide(rank - large, size)))
    return ranked.withColumn("decile", (decile + 1).cast("int")).drop("_n", "_start", "_all", "_within")


def placebo_drops(works: DataFrame, key: str, length: str, dropped: Column, replicate: int) -> DataFrame:
    """As many works as were dropped in each decile of length, chosen by hash among all."""
    dealt = deciles(works.select(key, length, dropped.alias("was_dropped"), hash_number(F.lit(replicate), F.col(key)).alias("_h")), key, length)
    wanted = dealt.groupBy("decile").agg(F.sum(F.col("was_dropped").cast("long")).alias("wanted"))
    return places(dealt, ["decile"], "_h", key).join(F.broadcast(wanted), "decile").where("place <= wanted").select(key, "decile")  # ten rows


def version_lines(tokens: DataFrame, key: str, ranges: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """(key, segment, line): the lines that a version of a cell is made of: runs of kept tokens of works that aren't dropped, in order.

    ``tokens``: key, at, start, end, token.
    """
    kept = tokens if dropped is None else tokens.join(dropped.select(key).distinct(), key, "left_anti")
    cuts = ranges.select(key, F.col("start").alias("_at"), F.lit(1).alias("_cut"), F.col("end").alias("_until"))
    both = kept.withColumns({"_at": F.col("end"), "_cut": F.lit(0)}).unionByName(cuts, allowMissingColumns=True)
    # the ranges that start before a token ends are those before it in this order; unless one reaches into the token, all have passed
    before = Window.partitionBy(key).orderBy("_at", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    placed = both.withColumns({"_passed": F.coalesce(F.sum("_cut").over(before), F.lit(0)).cast("int"), "_reach": F.max("_until").over(before)}).where("_cut = 0")
    words = F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"])
    outside = placed.where(F.col("_reach").isNull() | (F.col("_reach") <= F.col("start")))
    return outside.groupBy(key, F.col("_passed").alias("segment")).agg(F.array_join(words, " ").alias("line"))


def placebo_passages(works: DataFrame, key: str, tokens: str, removed: str, replicate: int) -> DataFrame:
    """(key, first, end): for each work a passage of as many tokens as it lost, at a place that a hash draws; a work that lost all loses all."""
    n, cut = F.col(tokens), F.least(removed, tokens)
    first = F.pmod(hash_number(F.lit(replicate), F.col(key)), n - cut + 1)
    return works.where((F.col(removed) > 0) & (n > 0)).select(key, first.alias("first"), (first + cut).alias("end"))


def with_replacement(works: DataFrame, key: str, cell: str, draws: int) -> DataFrame:
    """(cell, draw, key): as many draws with replacement in each cell, draw i being the row at hash(cell, i) mod n."""
    placed = in_order(works.select(cell, key), [cell], [key], "_place").select(cell, key, (F.col("_place") - 1).alias("place"))
    sizes = placed.groupBy(cell).agg(F.count("*").alias("n"))
    drawn = sizes.select(cell, "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select(cell, "draw", F.pmod(hash_number(F.col(cell), F.col("draw")), F.col("n")).alias("place"))
    return drawn.join(placed, [cell, "place"]).select(cell, "draw", key)


def planted_change(works: DataFrame, key: str, cell: Column, donor: Column, share: float) -> DataFrame:
    """(key, replaced_by): a share of the cell's rows, first by hash, each replaced by the donor of the same place."""
    sides = works.select(key, F.when(cell, "cell").when(donor, "donor").alias("side"), hash_number(F.lit("plant"), F.col(key)).alias("_h")).where("side is not null")
    placed = places(sides, ["side"], "_h", key).select(key, "side", "place")
    n = placed.where("side = 'cell'").agg(F.floor(F.lit(share) * F.count("*")).alias("n"))
    cells = placed.where("side = 'cell'").crossJoin(F.broadcast(n)).where("place <= n")  # one row
    return cells.select(key, "place").join(placed.where("side = 'donor'").select(F.col(key).alias("replaced_by"), "place"), "place").select(key, "replaced_by")
