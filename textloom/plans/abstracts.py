"""Cleaning of single abstracts over ``documents``, and flat works from nested records that the driver tables are made into."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import bibliographic as B
from ..functions import text as T
from ..operators import abstracts, patterns, records, repair
from .linked import _CASES, PROFILES
from .registry import query

_RE = lambda pattern: pattern.replace("'", "''")
_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_WORD = _RE(abstracts.WORD)

#: One pattern that drops the work, and one that removes the rest of its sentence.
_EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:[.][A-Za-z0-9_-]+)+"
_NOTICE = "(?:[Ll]icensed under|[Rr]eleased under)"
CLEANING = [{"id": "email", "label": "contact", "scope": "abstract", "regex": _EMAIL}, {"id": "license", "label": "license", "scope": "rest_of_sentence", "regex": _NOTICE}]

_SENTENCES = f"""
  s AS (SELECT doc_id, i, w[i] AS sentence FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \n]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS w FROM documents), unnest(range(1, len(w) + 1)) AS u(i)),
  t AS (SELECT *, regexp_extract_all(lower(sentence), '\\p{{L}}+') AS w FROM s), c AS (SELECT *, list_reverse_sort([{_CASES}]) AS r FROM t),
  g AS (SELECT doc_id, sentence, CASE WHEN r[1].score > 0 AND r[1].score - r[2].score >= 0.1 THEN r[1].lang ELSE 'und' END AS language FROM c)
"""


# the marks of mis-decoded text are put in for some documents: the tables hold none
@query("clean_abstracts", f"""
  WITH {_SENTENCES},
  n AS (SELECT doc_id, language IN ('en', 'und') AS is_kept, len(regexp_extract_all(sentence, '{_WORD}')) AS words,
    len(regexp_extract_all(regexp_replace(CASE WHEN regexp_matches(sentence, '{_NOTICE}') THEN regexp_extract(sentence, '(?s)^(.*?){_NOTICE}', 1) ELSE sentence END, '{_EMAIL}', ' ', 'g'), '{_WORD}')) AS left_ FROM g),
  a AS (SELECT doc_id, coalesce(sum(left_) FILTER (WHERE is_kept), 0) AS kept, coalesce(sum(words) FILTER (WHERE NOT is_kept), 0) AS other, max(words) > 150 AS is_malformed FROM n GROUP BY doc_id),
  d AS (SELECT doc_id, text, coalesce(kept, 0) AS kept, coalesce(other, 0) AS other, coalesce(is_malformed, false) AS is_malformed FROM documents LEFT JOIN a USING (doc_id))
  SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'mojibake' WHEN regexp_matches(text, '{_EMAIL}') THEN 'contact' WHEN kept < 25 AND other > kept THEN 'not_english' WHEN kept < 5 THEN 'too_short' END AS dropped_reason, is_malformed FROM d
""")
def clean_abstracts(t):
    """Every document as an abstract: sentences with their language, pattern matches, ranges, flags and the reason to drop it."""
    lower = lambda x: F.regexp_extract_all(F.lower(x["sentence"]), F.lit(r"\p{L}+"), F.lit(0))
    tagged = F.transform(T.sentence_spans(F.col("text")), lambda x: x.withField("language", patterns.sentence_language(lower(x), PROFILES)))
    works = t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit(" Ã©"))).otherwise(F.col("text")).alias("raw"), tagged.alias("sentences"), patterns.pattern_spans(F.col("text"), CLEANING).alias("spans"))
    out = abstracts.clean_abstracts(works, 25)
    return out.select("doc_id", "dropped_reason", F.array_contains("flags", "malformed").alias("is_malformed"))


_STRIPPED = f"regexp_replace(regexp_replace(text, '{_RE(T.APPENDED_FOOTER)}', ' ', 'g'), '{_RE(T.COPYRIGHT)}', ' ', 'g')"


@query("strip_boilerplate", f"SELECT doc_id, md5({_STRIPPED}) AS stripped FROM (SELECT doc_id, text || ' © 2001 by ' || source || '. ' || text || ' Copyright the Press. All rights reserved.' AS text FROM documents)")
def strip_boilerplate(t):
    """Copyright lines are put in: between two copies of a text, and at its end."""
    text = F.concat("text", F.lit(" © 2001 by "), "source", F.lit(". "), "text", F.lit(" Copyright the Press. All rights reserved."))
    return t.documents.select("doc_id", F.md5(T.strip_boilerplate(text)).alias("stripped"))


def _cell_sql() -> str:
    variants = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in repair.TARGET_VARIANTS.items()) + "}"
    return f"""
  p AS (SELECT doc_id, lang, source, text, {_STRIPPED} AS stripped FROM documents),
  q AS (SELECT *, lower(regexp_replace(regexp_replace(stripped, '(https?://|\\b(?:www\\.|doi\\.org/|10\\.\\d{{4,9}}/))[^\\s]+', ' ', 'gi'), '¬\\s*', '', 'g')) AS t FROM p),
  a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(strip_accents(t), '[^\\x00-\\x7F]', '', 'g'), '\\$\\$.*?\\$\\$', ' ', 'gs'), '\\$[^$]+\\$', ' ', 'g') AS ascii FROM q),
  w AS (SELECT *, list_transform(list_filter(list_transform(string_split_regex(replace(regexp_replace(ascii, '[^a-z0-9-]', ' ', 'g'), '--', '  '), ' +'), lambda x: trim(x, '-')), lambda x: x <> ''),
    lambda x: array_to_string(list_transform(string_split(x, '-'), lambda v: coalesce({variants}[v], v)), '-')) AS w FROM a),
  n AS (SELECT doc_id, lang, source, array_to_string(w, ' ') AS clean, CASE WHEN regexp_matches(text, '{_RE(abstracts.CATALOGUE_RECORD)}') OR regexp_matches(text, '{_RE(abstracts.CITATION_RECORD)}') THEN 'catalogue_record'
    WHEN regexp_matches(text, '{_RE(abstracts.WEB_PAGE)}') THEN 'web_page' WHEN len(w) < 5 THEN 'empty'
    WHEN NOT (len(list_filter(w, lambda x: x IN ({_LIST(T.CHECK_ENGLISH)}))) > len(list_filter(w, lambda x: x IN ({_LIST(T.CHECK_OTHER)}))) AND len(list_filter(w, lambda x: x IN ({_LIST(T.CHECK_ENGLISH)}))) >= 0.05 * len(w)) THEN 'not_english' END AS first_ FROM w),
  r AS (SELECT *, coalesce(first_, CASE WHEN row_number() OVER (PARTITION BY lang, first_ IS NULL, clean ORDER BY doc_id) > 1 THEN 'duplicate' END) AS reason FROM n),
  k AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(doc_id::VARCHAR), doc_id) > greatest(1, floor(0.05::DOUBLE * count(*) OVER (PARTITION BY lang))) AS is_over FROM r WHERE reason IS NULL),
  cell AS (SELECT doc_id, lang, coalesce(reason, CASE WHEN is_over THEN 'author_cap' END) AS dropped_reason FROM r LEFT JOIN k USING (doc_id))
"""


def _cell(t):
    works = t.documents.select("doc_id", "lang", "text", F.array("source").alias("authors"))
    return abstracts.clean_cell(works, "doc_id", "authors", ["lang"], 0.05)


@query("clean_cell", f"WITH {_cell_sql()} SELECT doc_id, lang, dropped_reason FROM cell")
def clean_cell(t):
    """Languages as cells and sources as authors, of which none may have more than a twentieth of a cell's kept works."""
    return _cell(t).select("doc_id", "lang", "dropped_reason")


@query("clean_cell_counts", f"WITH {_cell_sql()} SELECT lang, coalesce(dropped_reason, 'kept') AS outcome, count(*) AS works FROM cell GROUP BY 1, 2")
def clean_cell_counts(t):
    return abstracts.rule_counts(_cell(t), ["lang"])


_STOP = _LIST(T.ENGLISH)


@query("quality_v2", f"""
  WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS parts,
    regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
  e AS (SELECT doc_id, i, parts[i] AS part, CASE WHEN length(parts[i]) BETWEEN 40 AND 300 THEN lower(parts[i]) END AS key FROM p, unnest(range(1, len(parts) + 1)) AS u(i)),
  shared AS (SELECT key FROM e WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 20),
  m AS (SELECT doc_id, count(shared.key) AS stripped, coalesce(sum(length(part)) FILTER (WHERE shared.key IS NOT NULL), 0) AS chars, coalesce(string_agg(part, ' ' ORDER BY i) FILTER (WHERE shared.key IS NULL), '') AS rest
    FROM e LEFT JOIN shared ON shared.key = e.key GROUP BY doc_id),
  r AS (SELECT doc_id, text, coalesce(stripped, 0) AS stripped, rest, CASE WHEN regexp_matches(text, '{_RE(abstracts.SPAM)}') THEN 'spam'
    WHEN len(w) >= 20 AND len(list_filter(w, lambda x: x IN ({_STOP}))) / len(w) < 0.15 THEN 'not_english' WHEN stripped > 0 AND chars >= 0.5 * greatest(length(text), 1) THEN 'template' END AS dropped_reason FROM p LEFT JOIN m USING (doc_id))
  SELECT doc_id, dropped_reason, stripped, CASE WHEN dropped_reason IS NULL THEN md5(CASE WHEN stripped = 0 THEN text ELSE rest END) END AS clean FROM r
""")
def quality_v2(t):
    """Spam, languages and notices that many texts share."""
    out = abstracts.clean_shared(t.documents, "doc_id")
    return out.select("doc_id", "dropped_reason", "stripped", F.md5("clean_text").alias("clean"))


def _issn(number):
    """Seven digits and a last character that is right for some numbers only."""
    digits = F.lpad((number * 7919 % 10000000).cast("string"), 7, "0")
    k = number % 11
    return F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 3), F.when(k == 10, "X").otherwise(k.cast("string")))


_ISSN_SQL = """left(lpad((n * 7919 % 10000000)::VARCHAR, 7, '0'), 4) || '-' || substr(lpad((n * 7919 % 10000000)::VARCHAR, 7, '0'), 5, 3) || CASE WHEN n % 11 = 10 THEN 'X' ELSE (n % 11)::VARCHAR END"""
_VALID_SQL = "((11 - list_sum(list_transform(range(1, 8), lambda i: substr(lpad((n * 7919 % 10000000)::VARCHAR, 7, '0'), i::INT, 1)::INT * (9 - i)))::INT % 11) % 11 = n % 11)"
_JOINED = lambda c: F.array_join(c, ",")


# customers as metadata records: nested, some missing, some with a corrected or an empty DOI
@query("openalex_works", f"""
  WITH c AS (SELECT c_custkey AS n, * FROM customer), v AS (SELECT *, {_ISSN_SQL} AS issn, {_VALID_SQL} AS is_valid FROM c)
  SELECT 'https://openalex.org/W' || n AS work_id, n % 97 = 0 AS is_missing,
    CASE WHEN n % 13 = 0 THEN NULL WHEN n % 7 = 0 THEN '10.9999/fixed' WHEN n % 5 = 0 THEN NULL ELSE '10.1234/ab' || n END AS doi, n::VARCHAR AS pmid, 'PMC' || n AS pmcid, c_name AS title, c_mktsegment AS openalex_type,
    CASE WHEN n % 3 = 0 THEN NULL ELSE 1900 + n % 120 END AS publication_year, CASE WHEN n % 2 = 0 THEN 'en' END AS language, c_name AS source_name, CASE WHEN n % 4 = 0 THEN 'repository' ELSE 'journal' END AS source_type,
    CASE WHEN is_valid THEN issn END AS issn_l, CASE WHEN is_valid THEN '0378-5955,' || issn ELSE '0378-5955' END AS issns, CASE WHEN n % 6 = 0 THEN 'crossref' ELSE '' END AS indexed_in, n % 10 = 0 AS is_paratext, false AS is_retracted, n % 4 = 0 AND n % 6 <> 0 AS is_repository_only
  FROM v
""")
def openalex_works(t):
    n = F.col("c_custkey")
    source = F.struct(F.col("c_name").alias("display_name"), F.when(n % 4 == 0, "repository").otherwise("journal").alias("type"), _issn(n).alias("issn_l"), F.array(F.lit("0378-5955"), _issn(n), F.lit("bad")).alias("issn"))
    record = F.struct(
        F.concat(F.lit("https://openalex.org/W"), n).alias("id"),
        F.when(n % 97 == 0, True).alias("missing"),
        F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("https://doi.org/10.1234/AB"), n)).alias("doi"),
        F.struct(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), n).alias("pmid"), F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), n).alias("pmcid")).alias("ids"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("type"),
        F.when(n % 3 == 0, "2020-02-30").otherwise(F.concat((1900 + n % 120).cast("string"), F.lit("-05-17"))).alias("publication_date"),
        F.when(n % 2 == 0, "en").alias("language"),
        F.struct(source.alias("source")).alias("primary_location"),
        F.when(n % 6 == 0, F.array(F.lit("crossref"))).alias("indexed_in"),
        F.when(n % 10 == 0, True).alias("is_paratext"),
    )
    metadata = t.customer.select(F.from_json(F.to_json(record), schemas.METADATA).alias("r")).select("r.*")
    fixed = t.customer.where((n % 7 == 0) | (n % 13 == 0)).select(F.concat(F.lit("https://openalex.org/W"), n).alias("id"), F.when(n % 13 != 0, "https://doi.org/10.9999/FIXED").alias("doi"))
    out = B.openalex_works(metadata, fixed).withColumn("is_repository_only", B.is_repository_only(F.col("source_type"), F.col("indexed_in")))
    return out.withColumns({"issns": _JOINED("issns"), "indexed_in": _JOINED("indexed_in")})


# parts as registry records, their abstracts as mark-up
@query("crossref_works", """
  WITH p AS (SELECT p_partkey AS n, * FROM part)
  SELECT n::VARCHAR AS work_id, '10.1/x' || n AS doi, n % 31 <> 0 AS is_found, n % 37 = 0 AS is_invalid_doi, p_type AS crossref_type, p_name AS title, p_brand AS container_title, '0378-5955' AS issns, (1950 + p_size)::BIGINT AS published_year,
    p_brand || ' and ' || p_type || ' & more' AS abstract, n || '-' || (n + p_size) AS page, (p_size + 1)::BIGINT AS page_count, p_size::BIGINT AS references_count, CASE WHEN n % 2 = 0 THEN 'has-part,is-part-of' ELSE '' END AS relation_types,
    CASE WHEN n % 3 = 0 THEN 'correction,retraction' ELSE '' END AS update_types, n % 11 = 0 AS is_updated, 'https://a/' || p_size AS licence_urls, p_size % 2 = 0 AS has_text_mining_licence, CASE WHEN p_size % 5 = 0 THEN 'https://tdm/' || n ELSE '' END AS text_mining_links, (DATE '2024-03-01' + p_size::INT)::VARCHAR AS fetched
  FROM p
""")
def crossref_works(t):
    n, size = F.col("p_partkey"), F.col("p_size")
    typed = lambda name: F.struct(F.lit(name).alias("type"))
    link = lambda use: F.struct(F.concat(F.lit("https://tdm/"), n).alias("URL"), use.alias("intended-application"))
    record = F.struct(
        n.cast("string").alias("work_id"),
        F.concat(F.lit("10.1/X"), n).alias("identifier"),
        F.date_add(F.lit("2024-03-01"), size.cast("int")).cast("string").alias("fetched"),
        F.when(n % 31 == 0, True).alias("missing"),
        F.when(n % 37 == 0, True).alias("invalid_doi"),
        F.col("p_type").alias("type"),
        F.array("p_name", F.lit("other")).alias("title"),
        F.array("p_brand").alias("container-title"),
        F.array(F.lit("0378-5955"), F.lit("0378-5954")).alias("ISSN"),
        F.struct(F.array(F.array((1950 + size).cast("bigint"), F.lit(2).cast("bigint"))).alias("date-parts")).alias("published"),
        F.concat(F.lit("<jats:title>Abstract</jats:title><jats:p>"), "p_brand", F.lit(" and <i>"), "p_type", F.lit("</i>\n &amp; more</jats:p>")).alias("abstract"),
        F.concat(n.cast("string"), F.lit("-"), (n + size).cast("string")).alias("page"),
        size.cast("bigint").alias("references-count"),
        F.when(n % 2 == 0, '{"is-part-of":[1],"has-part":[]}').alias("relation"),
        F.when(n % 3 == 0, F.array(typed("retraction"), typed("correction"), typed("retraction"))).alias("update-to"),
        F.when(n % 11 == 0, F.array(typed("x"))).alias("updated-by"),
        F.array(F.struct(F.concat(F.lit("https://a/"), size).alias("URL"), F.when(size % 2 == 0, "tdm").otherwise("vor").alias("content-version"))).alias("license"),
        F.array(link(F.when(size % 5 == 0, "text-mining").otherwise("syndication"))).alias("link"),
    )
    rows = t.part.select(F.from_json(F.to_json(record), schemas.CROSSREF).alias("r")).select("r.*")
    out = B.crossref_works(rows, repair.column(repair.markup_text))
    return out.withColumn("fetched", F.col("fetched").cast("string")).withColumns({c: _JOINED(c) for c in ("issns", "relation_types", "update_types", "licence_urls", "text_mining_links")})


# suppliers as article records with structured abstracts
@query("pubmed_works", """
  WITH s AS (SELECT s_suppkey AS n, * FROM supplier)
  SELECT 'W' || n AS work_id, n::VARCHAR AS pmid, n % 9 <> 0 AS is_found, n % 8 = 0 AS is_book, CASE WHEN n % 2 = 0 THEN 'ppublish' END AS status, s_name AS title, 'Journal Article' AS publication_types, s_nationkey || ',other' AS mesh_descriptors, CASE WHEN n % 3 = 0 THEN s_nationkey::VARCHAR ELSE 'other' END AS mesh_major_descriptors,
    '' AS keywords, 'eng' AS languages, CASE WHEN n % 4 = 0 THEN NULL WHEN n % 4 = 1 THEN 'AIM: ' || s_name || ' end.' ELSE s_name || ' end.' END AS abstract, n % 4 = 1 AS is_structured_abstract, CASE WHEN n % 5 = 0 THEN NULL ELSE '1649-53' END AS page, CASE WHEN n % 5 = 0 THEN NULL ELSE 5::BIGINT END AS page_count,
    s_name AS journal, CASE WHEN n % 2 = 0 THEN n::VARCHAR END AS journal_nlm_id, 'CommentIn,ErratumIn' AS comment_types, '2024-01-31' AS fetched FROM s
""")
def pubmed_works(t):
    n = F.col("s_suppkey")
    part = lambda label, text: F.struct(label.alias("label"), text.alias("text"))
    heading = lambda name, major: F.struct(name.alias("descriptor"), major.alias("is_major"))
    typed = lambda name: F.struct(F.lit(name).alias("type"))
    record = F.struct(
        F.concat(F.lit("W"), n).alias("work_id"),
        n.cast("string").alias("identifier"),
        F.lit("2024-01-31").alias("fetched"),
        F.when(n % 9 == 0, True).alias("missing"),
        F.when(n % 8 == 0, True).alias("is_book"),
        F.when(n % 2 == 0, "ppublish").otherwise("").alias("status"),
        F.col("s_name").alias("title"),
        F.when(n % 4 != 0, F.array(part(F.when(n % 4 == 1, "AIM").otherwise(""), F.col("s_name")), part(F.lit(""), F.lit("end.")))).alias("abstract"),
        F.array(F.lit("Journal Article")).alias("publication_types"),
        F.array(heading(F.col("s_nationkey").cast("string"), n % 3 == 0), heading(F.lit("other"), n % 3 != 0)).alias("mesh_headings"),
        F.array(F.lit("eng")).alias("languages"),
        F.when(n % 5 == 0, "").otherwise("1649-53").alias("pages"),
        F.col("s_name").alias("journal"),
        F.when(n % 2 == 0, n.cast("string")).otherwise("").alias("journal_nlm_id"),
        F.array(typed("ErratumIn"), typed("CommentIn"), typed("ErratumIn")).alias("comments_corrections"),
    )
    out = B.pubmed_works(t.supplier.select(F.from_json(F.to_json(record), schemas.PUBMED).alias("r")).select("r.*"))
    return out.withColumn("fetched", F.col("fetched").cast("string")).withColumns({c: _JOINED(c) for c in ("publication_types", "mesh_descriptors", "mesh_major_descriptors", "keywords", "languages", "comment_types")})


@query("late_persons", """
  SELECT o_orderkey, o_orderkey % 4 = 0 AND o_custkey % 3 <> 0 AND (year(o_orderdate) - 1990) % 5 <> 4 AS is_obituary FROM orders
""")
def late_persons(t):
    """Titles of a name and a life span; of every fourth order only, and not where a word is no name's or the death lies too far back."""
    year = F.year("o_orderdate")
    died = year - (year - 1990) % 5
    name = F.when(F.col("o_custkey") % 3 == 0, "History of the Town").otherwise("Jane van der Doe")
    title = F.concat(name, F.lit(" ("), (died - 80).cast("string"), F.lit("–"), died.cast("string"), F.when(F.col("o_orderkey") % 4 == 0, ")").otherwise(") and more"))
    return t.orders.select("o_orderkey", F.coalesce(records.names_a_late_person(title, year, 3), F.lit(False)).alias("is_obituary"))
