"""Cleaning of single abstracts: what is removed from a text, why a work is dropped, and a cell's ordered rules with their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import null_as_false
from ..functions import text as T
from ..shared import join_salted, not_first
from . import cleaning, patterns, repair

#: Words, as they are counted in texts and ranges.
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
MIN_WORDS = 5
MALFORMED_SENTENCE_WORDS = 150
PROSE_BEFORE_WORDS = 30
NOT_ENGLISH = "not_english"

#: Wording of records and pages that stand in place of an abstract, and of what publishers put around one.
CATALOGUE_RECORD = r"(?i)^\s*(letter|script|telegram|memo(randum)?|postcard|note)\s+(from|to|by)\b"
CITATION_RECORD = r"(?i)\bvolume \d+,? (issue|number) \d+\b.*\bpages? \d+"
WEB_PAGE = (
    r"(?i)^\s*no ?access|export citation|save to binder|add to favorites|track citations|e-alerts|clicking on the donut|"
    r"facebook\W{0,3}twitter\W{0,3}(linkedin|reddit|e-?mail)|download citation file|easybib|refworks|request reuse permissions|rft_id|(%2[0-9a-f]){3}"
)
SPAM = (
    r"(?i)\b(?:brain ?dumps?|exam dumps?|dumps (?:pdf|questions)|dumps4\w*|pass4sure|certification exams?|"
    r"exam questions and answers|actual (?:exam )?questions)\b"
)


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def find_removals(spans: Column, sentences: Column, text: Column, english: tuple[str, ...] = ("en", "und")) -> tuple[Column, Column]:
    """The ranges to remove, sorted, without those inside another of the same reason; and the labels that drop the work.

    ``spans``: start, end, label, scope; ``sentences``: start, end, language. By scope a match removes: tokens, itself; rest_of_sentence,
    from its start to the end of the sentence that its end is in; abstract, itself, and drops the work; abstract_or_sentence,
    the sentences it is in if enough words come before it, else as abstract. A sentence of another language goes whole.
    """
    holding = lambda at: F.get(F.filter(sentences, lambda x: (x["start"] <= at) & (x["end"] > at)), F.lit(0))
    prose = lambda s: words_in(F.substring(text, F.lit(1), s["start"].cast("int"))) >= PROSE_BEFORE_WORDS
    in_sentence = lambda s: (s["scope"] == "abstract_or_sentence") & prose(s)
    drops = lambda s: (s["scope"] == "abstract") | (s["scope"] == "abstract_or_sentence") & ~prose(s)

    def removed(s):
        whole = in_sentence(s)
        start = F.when(whole, F.coalesce(holding(s["start"])["start"], s["start"])).otherwise(s["start"])
        to_end = whole | (s["scope"] == "rest_of_sentence")
        end = F.when(to_end, F.greatest(F.coalesce(holding(s["end"] - 1)["end"], s["end"]), s["end"])).otherwise(s["end"])
        return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), s["label"].alias("reason"))

    foreign = F.transform(F.filter(sentences, lambda x: ~x["language"].isin(*english)), lambda x: F.struct(x["start"].cast("bigint").alias("start"), x["end"].cast("bigint").alias("end"), F.lit(NOT_ENGLISH).alias("reason")))
    ranges = F.array_sort(F.array_distinct(F.concat(F.transform(spans, removed), foreign)))
    labels = F.array_distinct(F.transform(F.filter(spans, drops), lambda s: s["label"]))
    return patterns.drop_nested(ranges), labels


def clean_abstracts(works: DataFrame, least_english: int, text: str = "text", raw: str = "raw", spans: str = "spans", sentences: str = "sentences") -> DataFrame:
    """``works`` with removals, flags and dropped_reason. Dropped works keep their row.

    The first reason that holds: mojibake in the raw text; the label of a pattern that drops the work; not_english, where fewer than
    ``least_english`` words are kept and more are removed as another language; too_short, where fewer than five are kept. A sentence of
    more than 150 words makes the work malformed.
    """
    removals, labels = find_removals(F.col(spans), F.col(sentences), F.col(text))
    marked = works.withColumns({"removals": removals, "_labels": labels, "_chunks": T.chunks(F.col(text))})
    within = lambda r: words_in(T.cut(F.col("_chunks"), r["start"], r["end"] - r["start"]))
    foreign = F.filter("removals", lambda r: r["reason"] == NOT_ENGLISH)
    inside = F.aggregate(foreign, F.lit(0), lambda n, r: n + within(r))
    counted = marked.withColumns({"_kept": words_in(T.kept_text(F.col(text), F.col("removals"))), "_foreign": inside})
    reason = (
        F.when(null_as_false(repair.has_mojibake(F.col(raw))), "mojibake")
        .when(F.size("_labels") > 0, F.get("_labels", F.lit(0)))
        .when((F.col("_kept") < least_english) & (F.col("_foreign") > F.col("_kept")), NOT_ENGLISH)
        .when(F.col("_kept") < MIN_WORDS, "too_short")
    )
    long = F.exists(F.col(sentences), lambda x: within(x) > MALFORMED_SENTENCE_WORDS)
    flags = F.when(long, F.array(F.lit("malformed"))).otherwise(F.array().cast("array<string>"))
    return counted.withColumns({"flags": flags, "dropped_reason": reason}).drop("_labels", "_chunks", "_kept", "_foreign")


def clean_cell(works: DataFrame, key: str, authors: str, cell: list[str], max_share: float, text: str = "text") -> DataFrame:
    """``works`` with their preprocessed text and dropped_reason, by the rules of a cell in their order.

    catalogue_record (also citation strings), web_page, empty (fewer than five words once boilerplate and links are gone),
    not_english, duplicate (an earlier work of the cell has the same text); then author_cap, over the works that are left: no author
    may have more than ``max_share`` of them, one at least. ``rule_counts`` counts what each rule took.
    """
    clean = repair.column(repair.preprocess_text, repair.TARGET_VARIANTS)(T.strip_boilerplate(F.coalesce(F.col(text), F.lit(""))))
    seen = works.withColumn("clean_text", clean).withColumn("_words", F.filter(F.split("clean_text", " "), lambda w: w != ""))
    english, other = (F.size(F.filter("_words", lambda w: w.isin(*ws))) for ws in (T.CHECK_ENGLISH, T.CHECK_OTHER))
    first = (
        F.when(null_as_false(F.col(text).rlike(CATALOGUE_RECORD) | F.col(text).rlike(CITATION_RECORD)), "catalogue_record")
        .when(null_as_false(F.col(text).rlike(WEB_PAGE)), "web_page")
        .when(F.size("_words") < MIN_WORDS, "empty")
        .when(~((english > other) & (english >= 0.05 * F.size("_words"))), NOT_ENGLISH)
    )
    ruled = seen.withColumns({"_first": first, "_digest": F.sha2("clean_text", 256)})
    # the dropped are no copies' originals: they number among themselves
    numbered = not_first(ruled.withColumn("_stays", F.col("_first").isNull()), [*cell, "_stays", "_digest"], [key], "_copy")
    ruled = cleaning.checkpoint(numbered.withColumn("dropped_reason", F.coalesce("_first", F.when(F.col("_copy"), "duplicate"))).drop("_first", "_digest", "_words", "_stays", "_copy"))
    capped = cleaning.cap_authors(ruled.where("dropped_reason is null"), key, authors, cell, max_share, 1)
    return cleaning.mark_dropped(ruled, capped, key, "author_cap")


def rule_counts(cleaned: DataFrame, cell: list[str]) -> DataFrame:
    """How many works of a cell each rule dropped, and how many are kept."""
    return cleaned.groupBy(*cell, F.coalesce("dropped_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("works"))


def trimmed_sentences(text: Column) -> Column:
    """Sentences without surrounding white space, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def clean_shared(works: DataFrame, key: str, least: int = 20, text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """(key, dropped_reason, clean_text, stripped): the second set of quality rules.

    spam: advertising for exam questions. not_english: 20 words or more of which fewer than 15 % are stop words. template: half of the text or
    more is sentences (40 to 300 characters, case aside) that ``least`` texts share; fewer of them go, and the rest is joined by one space.
    """
    stop = stop_words or T.ENGLISH
    rows = works.select(key, F.col(text).alias("_text"), F.posexplode_outer(trimmed_sentences(F.col(text))).alias("_at", "_part"))
    rows = rows.withColumn("_key", F.when(F.length("_part").between(40, 300), F.lower("_part")))
    shared = rows.where("_key is not null").groupBy("_key").agg(F.countDistinct(key).alias("_n")).where(F.col("_n") >= least).select("_key", F.lit(True).alias("_shared"))
    # sentences without a key, and those that many texts share, are dealt over several tasks
    marked = join_salted(rows.withColumn("_spread", F.xxhash64(key, "_at")), shared, ["_key"], "_spread", "left").withColumn("_shared", F.coalesce("_shared", F.lit(False)))
    part = F.struct("_at", "_part")
    found = marked.groupBy(key).agg(
        F.sum(F.when(F.col("_shared"), F.length("_part")).otherwise(0)).alias("_chars"),
        F.count(F.when(F.col("_shared"), 1)).alias("stripped"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_shared") & F.col("_part").isNotNull(), part))), lambda x: x["_part"]), " ").alias("_rest"),
    )
    words = T.latin_words(F.col(text))
    reason = (
        F.when(F.col(text).rlike(SPAM), "spam")
        .when((F.size(words) >= 20) & (T.share_of(words, stop) < 0.15), NOT_ENGLISH)
        .when((F.col("stripped") > 0) & (F.col("_chars") >= 0.5 * F.greatest(F.length(text), F.lit(1))), "template")
    )
    out = works.join(found, key).withColumn("dropped_reason", reason)
    kept = F.when(F.col("stripped") == 0, F.col(text)).otherwise(F.col("_rest"))
    return out.select(key, "dropped_reason", F.when(F.col("dropped_reason").isNull(), kept).alias("clean_text"), "stripped")
