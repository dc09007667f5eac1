"""Near-duplicates by exact Jaccard similarity of word shingles, and their order-dependent resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import materialise as checkpoint

SHINGLE_WORDS = 5


def shingle_sets(works: DataFrame, key: str, text: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(key, n, h): each work's distinct word shingles as sorted hashes. Words are lower-cased; a short text is one shingle, one without words has no row."""
    words = F.transform(T.words(F.lower(F.coalesce(F.col(text), F.lit("")))), lambda w: F.xxhash64(w))

    def runs(w):
        return F.when(F.size(w) <= size, F.array(F.xxhash64(w))).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size)))))

    # the array is bound once by transform(array(words)): the inner lambda would else split the text for each shingle
    once = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.sort_array(F.array_distinct(runs(w))))), 1)
    return works.select(key, once.alias("h")).where("h is not null").select(key, F.size("h").cast("bigint").alias("n"), "h")


def shingles(works: DataFrame, key: str, text: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(key, n, shingle): the shingles of each work, and how many it has."""
    return shingle_sets(works, key, text, size).select(key, "n", F.explode("h").alias("shingle"))


def copy_classes(sets: DataFrame, key: str) -> DataFrame:
    """(key, class): works with equal sets are one class, named by the least of their keys."""
    same = sets.select(key, F.xxhash64("h").alias("_a"), F.xxhash64("n", "h").alias("_b"))
    least = same.groupBy("_a", "_b").agg(F.min(key).alias("class"))
    return same.join(least, ["_a", "_b"]).select(key, "class")


def rare_first(sets: DataFrame, key: str) -> DataFrame:
    """(key, n, h): the shingles that several sets have, the rarest first. Those of one set alone, which come before them, only count in n."""
    frequency = sets.select(F.explode("h").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("f")).where("f > 1")
    shared = sets.select(key, "n", F.explode("h").alias("shingle")).join(frequency, "shingle")
    return shared.groupBy(key, "n").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("_h")).select(key, "n", F.col("_h.shingle").alias("h"))


def prefixes(shared: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, n, shingle, left): the first n - ceil(t n) + 1 shingles of each set, and how many follow each.

    Two sets of similarity t or more have one of them in common.
    """
    alone = F.col("n") - F.size("h")
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - alone
    rows = shared.where(length > 0).select(key, "n", alone.alias("_alone"), F.posexplode(F.slice("h", F.lit(1), length.cast("int"))).alias("_at", "shingle"))
    return rows.select(key, "n", "shingle", (F.col("n") - F.col("_alone") - F.col("_at") - 1).alias("left"))


def _may_reach(a: str, b: str, threshold: float) -> Column:
    """Whether sets that meet at a shingle can reach the threshold by their sizes and by what follows it in both.

    For the first shingle in common the bound holds; a pair passes there if it can at all.
    """
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    needed = F.lit(threshold / (1 + threshold)) * (n_a + n_b)
    return (F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b) - 1e-9) & (F.least(f"left_{a}", f"left_{b}") + 1 >= needed - 1e-9)


def _side(prefix: DataFrame, key: str, name: str) -> DataFrame:
    return prefix.select(F.col(key).alias(name), F.col("n").alias(f"n_{name}"), F.col("left").alias(f"left_{name}"), "shingle")


def verified(candidates: DataFrame, shared: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of the candidates (a, b) at the threshold, counted exactly."""
    with_a = candidates.join(shared.select(F.col(key).alias("a"), F.col("n").alias("na"), F.col("h").alias("ha")), "a")
    both = with_a.join(shared.select(F.col(key).alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.select("a", "b", (common / (F.col("na") + F.col("nb") - common)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def similar_pairs(sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """All pairs of sets at the threshold, by prefix filtering: (a, b, similarity) with a < b.

    Prefixes meet on a shingle, within the bounds that sizes and places set; what meets is counted exactly.
    """
    shared = checkpoint(rare_first(sets, key))
    prefix = prefixes(shared, key, threshold)
    met = _side(prefix, key, "a").join(_side(prefix, key, "b"), "shingle").where((F.col("a") < F.col("b")) & _may_reach("a", "b", threshold))
    return verified(met.select("a", "b").distinct(), shared, key, threshold)


#: While rounds of leaders settle this part of the undecided works, they go on; what is left meets in pairs.
WORTHWHILE = 0.2


def kept_by_leaders(shared: DataFrame, prefix: DataFrame, key: str, threshold: float) -> DataFrame:
    """(w): the works of ``prefix`` that stay if, in order of their keys, a work goes when an earlier one that stays is similar.

    In a round each shingle's first undecided work is its leader. A work that leads all its shingles has no earlier undecided work
    like it, so it stays, and of the works that meet it those that are similar go: a work meets leaders only, so N copies of one another make N
    candidates. Each round writes who is undecided and who stays. When rounds settle little, the rest meets in pairs and is resolved.
    """
    undecided, stays = checkpoint(prefix.select(F.col(key).alias("w")).distinct()), None
    left = undecided.count()
    while left:
        rows = prefix.join(undecided.select(F.col("w").alias(key)), key, "left_semi")
        led = checkpoint(rows.join(rows.groupBy("shingle").agg(F.min(F.struct(F.col(key).alias("u"), F.col("n").alias("n_u"), F.col("left").alias("left_u"))).alias("_lead")), "shingle").select(key, F.col("n").alias("n_v"), F.col("left").alias("left_v"), "_lead.*"))
        firsts = checkpoint(led.groupBy(F.col(key).alias("w")).agg(F.bool_and(F.col("u") == F.col(key)).alias("leads")).where("leads").select("w"))
        met = led.where((F.col("u") != F.col(key)) & _may_reach("u", "v", threshold)).select(F.col("u").alias("a"), F.col(key).alias("b")).distinct()
        gone = verified(met.join(firsts.select(F.col("w").alias("a")), "a", "left_semi"), shared, key, threshold).select(F.col("b").alias("w")).distinct()
        settled = checkpoint(firsts.select("w", F.lit(True).alias("stays")).union(gone.select("w", F.lit(False))))
        mine = settled.where("stays").select("w")
        stays = checkpoint(mine if stays is None else stays.union(mine))
        undecided = checkpoint(undecided.join(settled, "w", "left_anti"))
        before, left = left, undecided.count()
        if left and before - left < WORTHWHILE * before:
            rest = undecided.select(F.col("w").alias(key))
            rows = prefix.join(rest, key, "left_semi")
            met = _side(rows, key, "a").join(_side(rows, key, "b"), "shingle").where((F.col("a") < F.col("b")) & _may_reach("a", "b", threshold))
            pairs = checkpoint(verified(met.select("a", "b").distinct(), shared, key, threshold))
            lost = resolve_greedily(pairs).select(F.col("work").alias("w"))
            return stays.union(undecided.join(lost, "w", "left_anti"))
    return undecided if stays is None else stays


def resolve_by_leaders(sets: DataFrame, classes: DataFrame, key: str, threshold: float) -> DataFrame:
    """What ``resolve_near_duplicates`` gives, without the pairs of works that both go: (work, duplicate_of).

    ``sets``: of the first work of each class.
    """
    shared = checkpoint(rare_first(sets, key))
    prefix = checkpoint(prefixes(shared, key, threshold))
    stays = checkpoint(kept_by_leaders(shared, prefix, key, threshold))
    ours = prefix.join(stays.select(F.col("w").alias(key)), key, "left_semi")
    met = _side(ours, key, "a").join(_side(prefix, key, "b"), "shingle").where((F.col("a") != F.col("b")) & _may_reach("a", "b", threshold))
    near = verified(met.select("a", "b").distinct(), shared, key, threshold).select(F.col("b").alias("class"), F.col("a").alias("kept"), "similarity")
    lost = prefix.select(F.col(key).alias("class")).distinct().join(stays.select(F.col("w").alias("class")), "class", "left_anti")
    return _assigned(near, lost, classes, key)


def _assigned(near: DataFrame, lost: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """(work, duplicate_of) from (class, kept, similarity) and the classes whose first work goes: a copy of an earlier work always goes."""
    itself = classes.where(F.col(key) != F.col("class")).select("class").distinct().join(lost, "class", "left_anti")
    near = near.union(itself.select("class", F.col("class").alias("kept"), F.lit(1.0).alias("similarity")))
    found = classes.join(near, "class").where(F.col("kept") < F.col(key))
    return found.groupBy(F.col(key).alias("work")).agg(F.min_by("kept", F.struct(-F.col("similarity"), F.col("kept"))).alias("duplicate_of"))


def first_sets(works: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sets of the first work of each class, classes of equal sets)."""
    sets = checkpoint(shingle_sets(works, key, text))
    classes = checkpoint(copy_classes(sets, key))
    return sets.join(classes.where(F.col(key) == F.col("class")).select(key), key, "left_semi"), classes


def near_duplicate_resolution(works: DataFrame, key: str, threshold: float, text: str = "text") -> DataFrame:
    """(work, duplicate_of): in order of the keys, a work goes if an earlier one that stays is similar; the most similar is recorded, then the earliest."""
    return resolve_by_leaders(*first_sets(works, key, text), key, threshold)


def near_duplicates(works: DataFrame, key: str, threshold: float, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs between class representatives, classes of equal sets): no pair of different sets is lost, copies aren't expanded into pairs."""
    firsts, classes = first_sets(works, key, text)
    return checkpoint(similar_pairs(firsts, key, threshold)), classes


def resolve_near_duplicates(pairs: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """(work, duplicate_of): in order of the keys, a work goes if an earlier kept one is similar, the most similar being recorded, then the earliest.

    A copy of an earlier work always goes, so only representatives are resolved; which kept works a copy is similar to its class tells.
    """
    gone = checkpoint(resolve_greedily(pairs).select(F.col("work").alias("w")))
    both = pairs.union(pairs.select("b", "a", "similarity")).select(F.col("a").alias("class"), F.col("b").alias("kept"), "similarity")
    itself = classes.where(F.col(key) != F.col("class")).select("class", F.col("class").alias("kept"), F.lit(1.0).alias("similarity")).distinct()
    near = both.union(itself).join(gone, F.col("kept") == F.col("w"), "left_anti")
    found = classes.join(near, "class").where(F.col("kept") < F.col(key))
    return found.groupBy(F.col(key).alias("work")).agg(F.min_by("kept", F.struct(-F.col("similarity"), F.col("kept"))).alias("duplicate_of"))


def resolve_greedily(pairs: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(work, duplicate_of): in order, a work goes if an earlier kept one is similar, the most similar being recorded.

    Not connected components: in a chain a~b~c only b goes. A work without undecided or kept earlier neighbours is kept;
    later neighbours of kept works go; until none is undecided. Rounds follow the longest chain.
    """
    pairs = checkpoint(pairs)
    undecided = checkpoint(pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct())
    open_pairs, gone = pairs, None
    for _ in range(most_rounds):
        blocked = open_pairs.select(F.col("b").alias("w")).distinct()
        kept = undecided.join(blocked, "w", "left_anti")
        dropped = checkpoint(pairs.join(kept, pairs["a"] == kept["w"], "left_semi").join(undecided.select(F.col("w").alias("b")), "b", "left_semi").select("b").distinct())
        gone = dropped if gone is None else checkpoint(gone.union(dropped))
        decided = kept.union(dropped.select(F.col("b").alias("w"))).distinct()
        undecided = checkpoint(undecided.join(decided, "w", "left_anti"))
        if undecided.isEmpty():
            break
        lost = gone.select(F.col("b").alias("w")).distinct()
        open_pairs = pairs.join(undecided.select(F.col("w").alias("b")), "b", "left_semi").join(lost.select(F.col("w").alias("a")), "a", "left_anti")
    else:
        raise RuntimeError(f"undecided works after {most_rounds} rounds")
    kept_all = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct().join(gone.select(F.col("b").alias("w")), "w", "left_anti")
    final = pairs.join(kept_all.select(F.col("w").alias("a")), "a", "left_semi")
    best = F.min_by("a", F.struct(-F.col("similarity"), F.col("a")))
    return final.groupBy(F.col("b").alias("work")).agg(best.alias("duplicate_of"))


def benchmark_overlap(works: DataFrame, key: str, held_out: DataFrame, item: str, least: float) -> DataFrame:
    """(key, item, share): held-out items at least ``least`` of whose shingles a work has."""
    ours = shingles(works, key).select(key, "shingle")
    theirs = shingles(held_out, item).select(item, F.col("n").alias("of"), "shingle")
    return ours.join(theirs, "shingle").groupBy(key, item, "of").count().withColumn("share", F.col("count") / F.col("of")).where(F.col("share") >= least).select(key, item, "share")
