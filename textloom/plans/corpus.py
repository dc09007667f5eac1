"""Corpus rules over ``documents`` and over tables that stand in for works and authors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning, duplicates
from ..shared import not_first
from .registry import SENTENCES, WORDS, query

MIN_WORKS = 20


@query("template_sentences", f"""
  WITH s AS ({SENTENCES}), m AS (SELECT doc_id, regexp_replace(sentence, '[0-9]+', '0', 'g') AS masked FROM s)
  SELECT masked, count(DISTINCT doc_id) AS works FROM m GROUP BY masked HAVING count(DISTINCT doc_id) >= {MIN_WORKS}
""")
def template_sentences(t):
    return cleaning.template_sentences(cleaning.sentence_rows(t.documents, "doc_id"), "doc_id", MIN_WORKS)


@query("template_drops", f"""
  WITH s AS ({SENTENCES}), m AS (SELECT doc_id, sentence, regexp_replace(sentence, '[0-9]+', '0', 'g') AS masked FROM s),
  x AS (SELECT masked FROM m GROUP BY masked HAVING count(DISTINCT doc_id) >= {MIN_WORKS})
  SELECT doc_id, round(coalesce(sum(length(sentence)) FILTER (WHERE x.masked IS NOT NULL), 0) / sum(length(sentence)), 6) AS share,
         coalesce(sum(length(sentence)) FILTER (WHERE x.masked IS NOT NULL), 0) / sum(length(sentence)) > 0.5 AS is_dropped
  FROM m LEFT JOIN x USING (masked) GROUP BY doc_id
""")
def template_drops(t):
    shares = cleaning.template_shares(cleaning.sentence_rows(t.documents, "doc_id"), "doc_id", MIN_WORKS)
    return shares.select("doc_id", F.round("share", 6).alias("share"), "is_dropped")


@query("repeated_sentences", f"""
  WITH s AS ({SENTENCES}) SELECT doc_id, sentence, count(*) - 1 AS later_copies FROM s GROUP BY doc_id, sentence HAVING count(*) > 1
""")
def repeated_sentences(t):
    rows = cleaning.repeated_sentences(cleaning.sentence_rows(t.documents, "doc_id"), "doc_id")
    return rows.groupBy("doc_id", "sentence").agg(F.count("*").alias("later_copies"))


@query("kept_text", """
  WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])([ \n]+)', '\\1\\2' || chr(1), 'g'), chr(1)) AS w FROM documents),
  e AS (SELECT doc_id, i, w[i] AS piece, regexp_replace(w[i], '([.!?])[ \n]+$', '\\1') AS sentence FROM p, unnest(range(1, len(w) + 1)) AS u(i)),
  o AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS start,
               row_number() OVER (PARTITION BY doc_id, sentence ORDER BY i) AS copy FROM e),
  r AS (SELECT doc_id, start, start + length(sentence) AS stop FROM o WHERE copy > 1 AND sentence <> ''),
  g AS (SELECT doc_id, start, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS following, stop, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k FROM r),
  c AS (SELECT g.doc_id, sum(stop - start) AS cut,
               count(*) - count(*) FILTER (WHERE k = 1 AND start = 0) - count(*) FILTER (WHERE following = stop) AS gaps,
               count(*) FILTER (WHERE following IS NULL AND stop = length(text)) AS at_end
        FROM g JOIN documents d USING (doc_id) GROUP BY g.doc_id)
  SELECT d.doc_id, (length(d.text) - coalesce(cut, 0) + coalesce(gaps, 0) - coalesce(at_end, 0))::BIGINT AS kept_chars, coalesce(cut, 0)::BIGINT AS cut_chars
  FROM documents d LEFT JOIN c USING (doc_id)
""")
def kept_text(t):
    """Repeated sentences become removals, and the text outside them is put together."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,reason:string>>")
    works = t.documents.select("doc_id", "text", empty.alias("removals"))
    repeats = cleaning.repeated_sentences(cleaning.sentence_rows(works, "doc_id"), "doc_id")
    marked = cleaning.add_removals(works, repeats, "doc_id", "repeated_sentence")
    cut = F.aggregate("removals", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return marked.select("doc_id", F.length(T.kept_text(F.col("text"), F.col("removals"))).cast("bigint").alias("kept_chars"), cut.alias("cut_chars"))


@query("truncated_flag", """
  WITH e AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \n]+$', ''), '[)\\]}"''”’» ]+$', '') AS t FROM documents)
  SELECT doc_id FROM e WHERE t <> '' AND right(t, 1) NOT IN ('.', '!', '?')
""")
def truncated_flag(t):
    none = F.array().cast("array<string>")
    ranges = F.array().cast("array<struct<start:bigint,end:bigint,reason:string>>")
    works = t.documents.select("doc_id", "text", none.alias("flags"), ranges.alias("removals"))
    return cleaning.mark_truncated(works, "doc_id").where(F.array_contains("flags", "truncated")).select("doc_id")


_PAIRS = f"""
  w AS (SELECT doc_id, {WORDS} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS shingle FROM w WHERE len(w) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
  pairs AS (SELECT a, b, k / (x.n + y.n - k) AS similarity FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.8)
"""


_CLASSES = f"""
  {_PAIRS},
  sets AS (SELECT doc_id, list_sort(list(shingle)) AS h FROM s GROUP BY doc_id),
  classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class FROM sets)
"""


@query("near_duplicate_pairs", f"WITH {_CLASSES} SELECT a, b, round(similarity, 6) AS similarity FROM pairs WHERE a IN (SELECT class FROM classes) AND b IN (SELECT class FROM classes)")
def near_duplicate_pairs(t):
    """Pairs between the first works of each class of equal shingle sets; ``near_duplicate_classes`` has the rest."""
    pairs, _ = duplicates.near_duplicates(t.documents, "doc_id", 0.8)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("near_duplicate_classes", f"WITH {_CLASSES} SELECT doc_id, class FROM classes")
def near_duplicate_classes(t):
    return duplicates.copy_classes(duplicates.shingle_sets(t.documents, "doc_id"), "doc_id")


# one work after the other: it joins the gone unless all its earlier neighbours are gone
@query("near_duplicate_resolution", f"""
  WITH {_PAIRS},
  later AS (SELECT list_prepend(b, list(a)) AS x, b FROM pairs GROUP BY b),
  gone AS (SELECT list_reduce(list(x ORDER BY b), lambda acc, x: CASE WHEN len(list_filter(x[2:], lambda a: NOT list_contains(acc, a))) > 0 THEN list_append(acc, x[1]) ELSE acc END, []::BIGINT[]) AS g FROM later)
  SELECT b AS work, first(a ORDER BY similarity DESC, a) AS duplicate_of FROM pairs, gone WHERE list_contains(g, b) AND NOT list_contains(g, a) GROUP BY b
""")
def near_duplicate_resolution(t):
    return duplicates.near_duplicate_resolution(t.documents, "doc_id", 0.8)


@query("exact_duplicates", """
  SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, lang, lower(text) ORDER BY doc_id) AS copy FROM documents) WHERE copy > 1
""")
def exact_duplicates(t):
    return cleaning.exact_duplicates(t.documents, "doc_id", ["source", "lang"], F.lower("text")).select("doc_id", "source")


@query("author_cap_single", """
  WITH w AS (SELECT o_orderkey, o_custkey, o_orderpriority, year(o_orderdate)::INT AS yr FROM orders),
  l AS (SELECT o_orderpriority, yr, greatest(2, floor(0.001::DOUBLE * count(*)))::BIGINT AS author_limit FROM w GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, yr, o_custkey ORDER BY sha256(o_orderkey::VARCHAR)) AS place FROM w)
  SELECT o_orderkey, o_custkey, r.o_orderpriority, r.yr FROM r JOIN l ON l.o_orderpriority = r.o_orderpriority AND l.yr = r.yr WHERE place > author_limit
""")
def author_cap_single(t):
    works = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("yr"))
    return cleaning.cap_single_authors(works, "o_orderkey", "o_custkey", ["o_orderpriority", "yr"], 0.001, 2).select("o_orderkey", "o_custkey", "o_orderpriority", "yr")


# one author after the other, the most frequent first: of the works that are left, those beyond the limit go
@query("author_cap_greedy", """
  WITH w AS (SELECT o_orderkey, o_orderpriority, year(o_orderdate)::INT AS yr, sha256(o_orderkey::VARCHAR) AS h FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey),
  l AS (SELECT o_orderpriority, yr, greatest(5, floor(0.02::DOUBLE * count(*)))::BIGINT AS author_limit FROM w GROUP BY 1, 2),
  p AS (SELECT DISTINCT o_orderkey, o_orderpriority, yr, h, l_suppkey AS author FROM w JOIN lineitem ON l_orderkey = o_orderkey),
  a AS (SELECT o_orderpriority, yr, author, count(*) AS n, list(o_orderkey ORDER BY h, o_orderkey) AS works FROM p GROUP BY 1, 2, 3),
  c AS (SELECT a.o_orderpriority, a.yr, author_limit, list(works ORDER BY n DESC, author) AS steps FROM a JOIN l ON l.o_orderpriority = a.o_orderpriority AND l.yr = a.yr WHERE n > author_limit GROUP BY 1, 2, 3)
  SELECT unnest(list_reduce(steps, lambda acc, x: list_concat(acc, list_filter(x, lambda w: NOT list_contains(acc, w))[author_limit + 1:]), []::BIGINT[])) AS o_orderkey FROM c
""")
def author_cap_greedy(t):
    authors = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("authors"))
    works = t.orders.join(authors, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "authors", "o_orderpriority", F.year("o_orderdate").alias("yr"))
    return cleaning.cap_authors(works, "o_orderkey", "authors", ["o_orderpriority", "yr"], 0.02, 5)


@query("merge_cells", """
  SELECT l_orderkey, first(l_partkey ORDER BY l_linenumber, l_partkey, l_shipdate) AS l_partkey, first(l_shipdate ORDER BY l_linenumber, l_partkey, l_shipdate) AS l_shipdate,
         array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS fields
  FROM lineitem GROUP BY l_orderkey
""")
def merge_cells(t):
    out = cleaning.merge_cells(t.lineitem, "l_orderkey", "l_returnflag", ["l_linenumber", "l_partkey", "l_shipdate"], ["l_partkey", "l_shipdate"])
    return out.withColumn("fields", F.array_join("fields", ","))


@query("benchmark_overlap", """
  WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \n]+'), lambda w: w <> '') AS w FROM documents),
  b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \n]+'), lambda w: w <> '') AS w FROM benchmark),
  s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS shingle FROM w WHERE len(w) > 0),
  h AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS shingle FROM b WHERE len(w) > 0),
  n AS (SELECT item_id, count(*) AS n FROM h GROUP BY item_id)
  SELECT doc_id, item_id, round(count(*) / any_value(n), 6) AS share FROM s JOIN h USING (shingle) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.5
""")
def benchmark_overlap(t):
    out = duplicates.benchmark_overlap(t.documents, "doc_id", t.benchmark, "item_id", 0.5)
    return out.withColumn("share", F.round("share", 6))


_LATIN = "regexp_extract_all(lower(text), '[a-z]+')"
_ENGLISH = ", ".join(f"'{w}'" for w in T.ENGLISH)
_FOREIGN = ", ".join(f"'{w}'" for w in T.FOREIGN)


@query("english_share", f"""
  WITH w AS (SELECT doc_id, lang, {_LATIN} AS w FROM documents),
  c AS (SELECT doc_id, lang, len(w) AS n, len(list_filter(w, lambda x: x IN ({_ENGLISH}))) AS e, len(list_filter(w, lambda x: x IN ({_FOREIGN}))) AS f FROM w)
  SELECT doc_id, round(coalesce(e / nullif(n, 0), 0), 6) AS english, round(coalesce(f / nullif(n, 0), 0), 6) AS other, coalesce(e > f AND e >= 0.05 * n, false) AS looks_english FROM c
""")
def english_share(t):
    tokens = t.documents.select("doc_id", T.latin_words(F.col("text")).alias("w"))
    shares = tokens.select("doc_id", T.share_of(F.col("w"), T.ENGLISH).alias("e"), T.share_of(F.col("w"), T.FOREIGN).alias("f"))
    return shares.select("doc_id", F.round("e", 6).alias("english"), F.round("f", 6).alias("other"), ((F.col("e") > F.col("f")) & (F.col("e") >= 0.05)).alias("looks_english"))


@query("language_function_words", f"""
  WITH w AS (SELECT doc_id, lang, {_LATIN} AS w FROM documents),
  c AS (SELECT lang, len(list_filter(w, lambda x: x IN ({_ENGLISH}))) AS e, len(list_filter(w, lambda x: x IN ({_FOREIGN}))) AS f FROM w)
  SELECT lang, CASE WHEN e > f THEN 'en' WHEN f > e THEN 'other' ELSE 'und' END AS verdict, count(*) AS documents FROM c GROUP BY 1, 2
""")
def language_function_words(t):
    tokens = t.documents.select("lang", T.latin_words(F.col("text")).alias("w"))
    shares = tokens.select("lang", T.share_of(F.col("w"), T.ENGLISH).alias("e"), T.share_of(F.col("w"), T.FOREIGN).alias("f"))
    verdict = F.when(F.col("e") > F.col("f"), "en").when(F.col("f") > F.col("e"), "other").otherwise("und")
    return shares.groupBy("lang", verdict.alias("verdict")).agg(F.count("*").alias("documents"))


@query("foreign_share", """
  SELECT doc_id, len(regexp_extract_all(text, '\\p{L}'))::BIGINT AS letters, len(regexp_extract_all(text, '[^\\x{0000}-\\x{024F}\\P{L}]'))::BIGINT AS foreign_letters FROM documents
""")
def foreign_share(t):
    letters = F.regexp_count("text", F.lit(r"\p{L}")).cast("bigint")
    n = F.round(T.foreign_letter_share(F.col("text")) * letters).cast("bigint")
    return t.documents.select("doc_id", letters.alias("letters"), n.alias("foreign_letters"))


@query("drop_reasons", f"""
  WITH d AS (SELECT doc_id, source, lang, text, {WORDS} AS w FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS copy, len(list_filter(w, lambda x: x IN ({_ENGLISH}))) AS e FROM d)
  SELECT doc_id, CASE WHEN len(w) < 5 THEN 'short' WHEN len(w) >= 20 AND e < 0.05 * len(w) THEN 'not_english' WHEN copy > 1 THEN 'duplicate' END AS reason FROM r
""")
def drop_reasons(t):
    """Ordered rules of which the first that holds is the reason."""
    w = T.words(F.lower("text"))
    rows = not_first(t.documents.select("doc_id", "source", F.size(w).alias("n"), T.share_of(w, T.ENGLISH).alias("e"), F.sha2("text", 256).alias("digest")), ["source", "digest"], ["doc_id"], "copy")
    reason = F.when(F.col("n") < 5, "short").when((F.col("n") >= 20) & (F.col("e") < 0.05), "not_english").when(F.col("copy"), "duplicate")
    return rows.select("doc_id", reason.alias("reason"))
