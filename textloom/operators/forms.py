"""Counts of word forms and the decisions they lead to: glued words, broken words, lower-case glue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import dealt_finer
from .duplicates import checkpoint


def tokens_between(text: Column, kept: str) -> Column:
    """Lower-cased tokens of a text in which every character outside the class ``kept`` reads as a space."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), f"[^{kept}]+", " "), " "), lambda w: w != "")


#: Up to so many forms, or beginnings of forms of one length, are sent to the tasks that read the texts.
BROADCAST_FORMS = 2_000_000


def form_trie(forms: DataFrame) -> DataFrame:
    """(level, node, ends, goes_on): the first ``level`` words of every form, whether they are a form, and whether one goes on from there."""
    words = F.split("form", " ")
    beginnings = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.struct(k.alias("level"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("node"), (k < F.size(words)).alias("goes_on")))
    return forms.select(F.explode(beginnings).alias("b")).groupBy("b.level", "b.node").agg(F.bool_or(~F.col("b.goes_on")).alias("ends"), F.bool_or("b.goes_on").alias("goes_on"))


def count_forms(texts: DataFrame, forms: DataFrame, text: str = "text", kept: str = r"\p{L}\p{N} -") -> DataFrame:
    """How often each form, of any number of words, stands between spaces, case folded; overlapping places count.

    The forms make a trie, kept as a table of their beginnings. Every place of a text goes down it, a level at a time by a join; from the second
    level on only places whose words so far begin a form take part. A level of few enough nodes, which is counted, is broadcast.
    ``forms``: form, words between single spaces. A null text has no places; an empty form, or one with other spaces, stands nowhere.
    """
    wanted = checkpoint(forms.select("form").distinct())
    trie = checkpoint(form_trie(wanted.where(F.col("form") != "")))
    nodes = {r.level: r.n for r in trie.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row for each number of words
    depth = max(nodes, default=0)
    tokens = texts.select(tokens_between(F.col(text), kept).alias("w")).where(F.size("w") > 0)
    places = tokens.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.slice("w", i, F.lit(max(depth, 1))))).alias("tail"))
    places = places.withColumns({"found": F.array().cast("array<string>"), "alive": F.lit(True)})
    for level in range(1, depth + 1):
        step = trie.where(F.col("level") == level).select("node", "ends", "goes_on")
        few = nodes[level] <= BROADCAST_FORMS
        so_far = F.array_join(F.slice("tail", 1, level), " ")
        # a key that no node has, dealt by hash, for places that have left the trie
        key = F.when(F.col("alive") & (F.size("tail") >= level), so_far)
        key = key if few else F.coalesce(key, F.concat(F.lit("\x00"), F.xxhash64("tail").cast("string")))
        met = places.withColumn("node", key).join(F.broadcast(step) if few else step, "node", "inner" if level == 1 else "left")
        found = F.when(F.col("ends"), F.concat("found", F.array("node"))).otherwise(F.col("found"))
        places = met.select("tail", found.alias("found"), F.coalesce("goes_on", F.lit(False)).alias("alive"))
    counts = places.select(F.explode("found").alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    return wanted.join(counts, "form", "left").select("form", F.coalesce("n", F.lit(0)).alias("n"))


def sentence_openers(texts: DataFrame, text: str = "text") -> DataFrame:
    """Capitalised words that open sentences, with their rank (1 is the most common; ties share the least)."""
    opener = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?:^|[.!?][ \n]+)(\p{Lu}\p{L}*)"), F.lit(1)))
    counts = texts.select(opener.alias("opener")).groupBy("opener").agg(F.count("*").alias("n"))
    # a window over the vocabulary, which is aggregated already
    return counts.select("opener", F.rank().over(Window.orderBy(F.desc("n"))).cast("long").alias("opener_rank"))


GLUED = r"(?<!\p{L})(\p{L}*\p{Ll}\p{Lu}\p{L}*)(?!\p{L})"


def count_glued_words(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Words with one lower-to-upper boundary and two letters or more before it, with the counts that decide a split."""
    word = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(GLUED), F.lit(1))).alias("word"))
    single = word.where(F.regexp_count("word", F.lit(r"\p{Ll}\p{Lu}")) == 1)
    parts = r"^(\p{L}*\p{Ll})(\p{Lu}\p{L}*)$"
    table = (
        single.groupBy("word")
        .agg(F.countDistinct(key).alias("works"), F.count("*").alias("occurrences"))
        .withColumns({"left": F.regexp_extract("word", parts, 1), "right": F.regexp_extract("word", parts, 2)})
        .where("length(left) >= 2")
    )
    table = checkpoint(table.withColumns({"f_joined": F.lower("word"), "f_apart": F.concat(F.lower("left"), F.lit(" "), F.lower("right")), "f_left": F.lower("left")}))
    forms = table.select(F.explode(F.array("f_joined", "f_apart", "f_left")).alias("form"))
    counts = checkpoint(count_forms(texts, forms, text, r"\p{L}\p{N}"))
    for f, name in (("f_joined", "joined"), ("f_apart", "apart"), ("f_left", "left_alone")):
        table = table.join(counts.select(F.col("form").alias(f), F.col("n").alias(name)), f, "left").drop(f)
    return table.join(sentence_openers(texts, text), F.col("right") == F.col("opener"), "left").drop("opener").select("word", "left", "right", "works", "occurrences", "joined", "apart", "left_alone", "opener_rank")


def decide_glued_splits(counts: DataFrame, apart_margin: float, opener_count: int, least_left: int, least_right: int, kept_joined: list[str]) -> DataFrame:
    """``reason`` (kept_joined, apart, sentence_opener or null, the first that holds) and ``split``."""
    reason = (
        F.when(F.lower("word").isin([w.lower() for w in kept_joined]), "kept_joined")
        .when(F.col("apart") >= apart_margin * F.greatest("joined", F.lit(1)), "apart")
        .when((F.col("opener_rank") <= opener_count) & (F.length("left") >= least_left) & (F.length("right") >= least_right), "sentence_opener")
    )
    return counts.withColumn("reason", reason).withColumn("split", F.coalesce(F.col("reason").isin("apart", "sentence_opener"), F.lit(False)))


def vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    word = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0)))
    return texts.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def count_split_words(texts: DataFrame, dictionary: DataFrame, least: int, text: str = "text") -> DataFrame:
    """Every cut in two of every frequent word whose halves occur as words too, not both known to the dictionary.

    With how often the corpus writes the word whole, and broken by a space, a hyphen and space, or a hyphen; only cuts found
    broken stay. ``dictionary``: word.
    """
    words = checkpoint(vocabulary(texts, text))
    cuts = words.where((F.length("word") >= 4) & (F.col("n") >= least)).select("word", F.col("n").alias("joined"), F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    cuts = cuts.select("word", "joined", F.substr("word", F.lit(1), F.col("at")).alias("left"), F.substr("word", F.col("at") + 1).alias("right"))
    known = dictionary.select("word", F.lit(True).alias("known"))
    for side in ("left", "right"):
        cuts = cuts.join(words.select(F.col("word").alias(side)), side, "left_semi")
        cuts = cuts.join(known.select(F.col("word").alias(side), F.col("known").alias(f"{side}_is_word")), side, "left").withColumn(f"{side}_is_word", F.coalesce(f"{side}_is_word", F.lit(False)))
    cuts = checkpoint(cuts.where("not (left_is_word and right_is_word)"))
    kinds = {"space": " ", "hyphen_space": "- ", "hyphen": "-"}
    table = cuts.withColumns({f"f_{k}": F.concat("left", F.lit(s), "right") for k, s in kinds.items()})
    counts = checkpoint(count_forms(texts, table.select(F.explode(F.array(*(f"f_{k}" for k in kinds))).alias("form")), text))
    for k in kinds:
        table = table.join(counts.select(F.col("form").alias(f"f_{k}"), F.col("n").alias(k)), f"f_{k}", "left").drop(f"f_{k}")
    return table.where("space + hyphen_space + hyphen > 0").select("word", "left", "right", "left_is_word", "right_is_word", "joined", "space", "hyphen_space", "hyphen")


def decide_split_joins(counts: DataFrame, join_margin: float, hyphen_margin: float, kept_apart: list[tuple[str, str]]) -> DataFrame:
    apart = F.concat("left", F.lit(" "), "right").isin([f"{a} {b}".lower() for a, b in kept_apart]) if kept_apart else F.lit(False)
    broken = F.col("space") + F.col("hyphen_space") + F.col("hyphen")
    long_enough = (F.length("left") >= 2) & (F.length("right") >= 2)
    return counts.withColumn("kept_apart", apart).withColumns({
        "join": (F.col("joined") >= join_margin * broken) & ~F.col("kept_apart"),
        "join_hyphenated": (F.col("joined") >= hyphen_margin * broken) & ~F.col("right_is_word") & long_enough & ~F.col("kept_apart"),
    })


def count_lower_glue(texts: DataFrame, dictionary: DataFrame, least: int, text: str = "text") -> DataFrame:
    """Unknown words that are two dictionary words in a row: the cut whose parts stand apart most often, then the first."""
    words = checkpoint(vocabulary(texts, text))
    known = dictionary.select("word")
    unknown = words.where(F.col("n") >= least).join(known, "word", "left_anti").where("length(word) >= 4")
    cuts = unknown.select("word", F.col("n").alias("joined"), F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("at"))
    cuts = cuts.select("word", "joined", "at", F.substr("word", F.lit(1), F.col("at")).alias("left"), F.substr("word", F.col("at") + 1).alias("right"))
    for side in ("left", "right"):
        cuts = cuts.join(known.select(F.col("word").alias(side)), side, "left_semi")
    cuts = checkpoint(cuts.withColumn("form", F.concat("left", F.lit(" "), "right")))
    counted = cuts.join(count_forms(texts, cuts, text), "form")
    best = F.max_by(F.struct("left", "right", F.col("n").alias("apart")), F.struct("n", -F.col("at")))
    return counted.groupBy("word", "joined").agg(best.alias("b")).select("word", "joined", "b.*")


def decide_lower_glue(counts: DataFrame, margin: float, kept_joined: list[str]) -> DataFrame:
    kept = F.col("word").isin(kept_joined) if kept_joined else F.lit(False)
    return counts.withColumn("split", (F.col("apart") >= margin * F.col("joined")) & ~kept)


#: Words of a task that counts pairs; it holds each of their distinct pairs once.
WORDS_A_TASK = 3_000_000


def bigram_npmi(texts: DataFrame, words: Column, least: int, threshold: float) -> DataFrame:
    """Neighbouring words with their normalised pointwise mutual information, at ``threshold`` or above.

    Words are counted first; their number tells over how many tasks the texts are dealt, so that the pairs of a task don't grow with the table.
    """
    single = checkpoint(texts.select(F.explode(words).alias("x")).groupBy("x").agg(F.count("*").alias("n")))
    total = single.agg(F.sum("n").alias("total"))
    w = dealt_finer(texts, -(-(total.first()["total"] or 0) // WORDS_A_TASK)).select(words.alias("w"))
    rest = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = w.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), rest).alias("a"), F.slice("w", F.lit(2), rest).alias("b"))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    joined = pairs.join(single.select(F.col("x").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("x").alias("b"), F.col("n").alias("nb")), "b").crossJoin(F.broadcast(total))  # one row
    npmi = F.ln(F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))) / -F.ln(F.col("n") / F.col("total"))
    return joined.select("a", "b", "n", npmi.alias("npmi")).where(F.col("npmi") >= threshold)


def split_parts(words: DataFrame, known: DataFrame, most_words: int = 500_000, longest: int = 24) -> DataFrame:
    """(word, parts): unknown words cut into three or more known words, by the likeliest cut under the known words' counts.

    ``words``: word; ``known``: word, n. The known words are held by every task, so their number is checked.
    """
    from .instruments import segment

    rows = known.where(F.length("word") <= longest).select("word", "n").limit(most_words + 1).collect()  # at most ``most_words``, checked
    if len(rows) > most_words:
        raise ValueError(f"more than {most_words} known words")
    counts = known.sparkSession.sparkContext.broadcast({r.word: r.n for r in rows})  # once for an executor, not with each task
    total = sum(counts.value.values())

    @F.pandas_udf("array<string>")
    def cut(column: pd.Series) -> pd.Series:
        return column.map(lambda w: segment(w, counts.value, total, longest))

    return words.select("word", cut("word").alias("parts")).where("size(parts) > 2")


def decide_separators(counts: DataFrame, forms: DataFrame) -> DataFrame:
    """``counts`` (word, left, right, ...) with ``separator``: a hyphen where the corpus writes the two parts with one more often than with a blank.

    ``forms``: form, n, as ``count_forms`` gives for both written forms.
    """
    spaced, hyphened = (forms.select(F.col("form").alias(f"f_{k}"), F.col("n").alias(f"n_{k}")) for k in ("space", "hyphen"))
    keyed = counts.withColumns({"f_space": F.concat("left", F.lit(" "), "right"), "f_hyphen": F.concat("left", F.lit("-"), "right")})
    joined = keyed.join(spaced, "f_space", "left").join(hyphened, "f_hyphen", "left")
    more = F.coalesce("n_hyphen", F.lit(0)) > F.coalesce("n_space", F.lit(0))
    return joined.withColumn("separator", F.when(more, "-").otherwise(" ")).drop("f_space", "f_hyphen", "n_space", "n_hyphen")


def split_lower_glue(sure: dict[str, str], guarded: dict[str, tuple[str, str]], least: int):
    """A column function: struct of the text with glued words split, and how many each pattern split.

    ``sure`` splits go everywhere; ``guarded`` ones (word -> pattern, split) only in texts with at least ``least`` sure ones, where
    glue is the text's own fault. Addresses stay.
    """
    from .repair import _WORDS, Run

    def split(text: str) -> dict:
        run = Run(text)
        words = [m for m in _WORDS.finditer(text) if (m[0].lower() in sure or m[0].lower() in guarded) and not run.covers(m.start())]
        allowed = sum(m[0].lower() in sure for m in words) >= least
        out, done, counts = [], 0, {}
        for m in words:
            word = m[0].lower()
            pattern, new = ("two_words", sure[word]) if word in sure else guarded[word]
            if word in sure or allowed:
                out += (text[done : m.start()], new[0].upper() + new[1:] if m[0][0].isupper() else new)
                done = m.end()
                counts[pattern] = counts.get(pattern, 0) + 1
        return {"text": "".join(out) + text[done:], "counts": counts}

    @F.pandas_udf("struct<text:string,counts:map<string,int>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [{"text": None, "counts": None} if t is None else split(t) for t in texts]
        return pd.DataFrame({"text": [r["text"] for r in rows], "counts": [r["counts"] for r in rows]})

    return run


def replace_words(texts: DataFrame, key: str, text: str, replacements: DataFrame) -> DataFrame:
    """(key, text, replaced): texts with whole words replaced wherever they stand, and how many. ``replacements``: word, replacement, each word once.

    Texts are cut into words and what is between them; the words meet the replacements in one join, and go back in order. ``key`` names a text
    once; a null text stays null.
    """
    pieces = texts.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))).alias("at", "word"))
    met = pieces.join(replacements.select("word", "replacement"), "word", "left").select(key, "at", F.coalesce("replacement", "word").alias("piece"), F.col("replacement").isNotNull().cast("long").alias("hit"))
    back = met.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("_text"), F.sum("hit").alias("replaced"))
    return texts.select(key, text).join(back, key, "left").select(key, F.coalesce("_text", text).alias(text), F.coalesce("replaced", F.lit(0)).alias("replaced"))


def repeated_texts(texts: DataFrame, text: str, least: int = 5) -> DataFrame:
    """(text, n): whole texts that stand at least ``least`` times; by digest, so that long texts aren't keys."""
    counts = texts.groupBy(F.sha2(text, 256).alias("digest")).agg(F.first(text).alias(text), F.count(text).alias("n"))
    return counts.where(F.col("n") >= least).select(text, "n")
