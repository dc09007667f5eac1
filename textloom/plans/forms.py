"""Word-form counts and decisions over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import forms, lemmas, repair
from ..operators.duplicates import checkpoint
from .registry import query

#: Glue is put in where a sentence ends: its stop and the space go, and the next sentence's first word joins on.
_GLUED_SQL = "SELECT doc_id, regexp_replace(text, '(\\p{Ll}{2})[.] (\\p{Lu})', '\\1\\2', 'g') AS text FROM documents"


def _glued(t):
    return t.documents.select("doc_id", F.regexp_replace("text", r"(\p{Ll}{2})[.] (\p{Lu})", "$1$2").alias("text"))


def _dictionary(t):
    """The benchmark's words stand in for a dictionary."""
    return forms.vocabulary(t.benchmark).select("word")


def _forms(kept: str, wanted: str) -> str:
    """Counts ``f`` of the one- and two-word forms that ``wanted`` selects, over texts ``x``."""
    return f"""
  p AS (SELECT row_number() OVER () AS r, list_filter(string_split(regexp_replace(lower(text), '[^{kept}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM x),
  placed AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM p),
  following AS (SELECT a, lead(a) OVER (PARTITION BY r ORDER BY i) AS b FROM placed),
  q AS MATERIALIZED ({wanted}),
  f AS MATERIALIZED (SELECT form, count(*) AS n FROM (SELECT a AS form FROM following UNION ALL SELECT a || ' ' || b FROM following WHERE b IS NOT NULL) SEMI JOIN q USING (form) GROUP BY form)
"""


_TWO, _HYPHENS = "\\p{L}\\p{N}", "\\p{L}\\p{N} -"

_TOKENS = "list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N} -]+', ' ', 'g'), ' '), lambda w: w <> '')"
_FORM_LIST = ["the", "of the", "in the", "der", "und der", "license", "licensed under", "et la", "de la", "not there at all", "the the the", "the the the the the"]


_LEADS = ", ".join(f"lead(a, {k}) OVER (PARTITION BY r ORDER BY i) AS b{k}" for k in range(1, 8))
_RUNS = " UNION ALL ".join(f"SELECT a{''.join(f' || chr(32) || b{j}' for j in range(1, k + 1))} AS form FROM following" for k in range(8))


@query("form_counts", f"""
  WITH p AS (SELECT row_number() OVER () AS r, {_TOKENS} AS w FROM documents), b AS (SELECT {_TOKENS} AS w FROM benchmark),
  q AS MATERIALIZED (SELECT unnest([{', '.join(f"'{x}'" for x in _FORM_LIST)}]) AS form UNION SELECT array_to_string(w[1:k], ' ') FROM b, unnest(range(1, 9)) AS u(k) WHERE len(w) >= k),
  placed AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM p), following AS (SELECT a, {_LEADS} FROM placed),
  f AS (SELECT form, count(*) AS n FROM ({_RUNS}) SEMI JOIN q USING (form) GROUP BY form)
  SELECT form, coalesce(n, 0) AS n FROM q LEFT JOIN f USING (form)
""")
def form_counts(t):
    """A list, and the first one to eight words of every text of the benchmark."""
    words = forms.tokens_between(F.col("text"), r"\p{L}\p{N} -")
    openings = t.benchmark.select(words.alias("w")).where(F.size("w") > 0)
    openings = openings.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("w"), F.lit(8))), lambda k: F.array_join(F.slice("w", F.lit(1), k), " "))).alias("form"))
    listed = t.spark.createDataFrame([(x,) for x in _FORM_LIST], "form string")
    return forms.count_forms(t.documents, listed.union(openings))


_GLUE = f"""
  x AS MATERIALIZED ({_GLUED_SQL}),
  g AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '\\p{{L}}+'), lambda w: len(regexp_extract_all(w, '\\p{{Ll}}\\p{{Lu}}')) = 1)) AS word FROM x),
  c AS MATERIALIZED (SELECT word, count(DISTINCT doc_id) AS works, count(*) AS occurrences, regexp_extract(word, '^(\\p{{L}}*\\p{{Ll}})(\\p{{Lu}}\\p{{L}}*)$', 1) AS "left",
               regexp_extract(word, '^(\\p{{L}}*\\p{{Ll}})(\\p{{Lu}}\\p{{L}}*)$', 2) AS "right" FROM g GROUP BY word),
  {_forms(_TWO, """SELECT lower(word) AS form FROM c UNION SELECT lower("left") || ' ' || lower("right") FROM c UNION SELECT lower("left") FROM c""")},
  o AS (SELECT opener, rank() OVER (ORDER BY count(*) DESC) AS opener_rank FROM (SELECT unnest(regexp_extract_all(text, '(?:^|[.!?][ \n]+)(\\p{{Lu}}\\p{{L}}*)', 1)) AS opener FROM x) GROUP BY opener),
  t AS (SELECT word, "left", "right", works, occurrences, coalesce(a.n, 0) AS joined, coalesce(b.n, 0) AS apart, coalesce(d.n, 0) AS left_alone, opener_rank
        FROM c LEFT JOIN f a ON a.form = lower(word) LEFT JOIN f b ON b.form = lower("left") || ' ' || lower("right") LEFT JOIN f d ON d.form = lower("left") LEFT JOIN o ON o.opener = c."right"
        WHERE length("left") >= 2)
"""


@query("glued_counts", f"WITH {_GLUE} SELECT * FROM t")
def glued_counts(t):
    """Over texts into which glue was put: the tables hold none."""
    return forms.count_glued_words(_glued(t), "doc_id")


@query("glued_decisions", f"""
  WITH {_GLUE}, r AS (SELECT word, CASE WHEN lower(word) IN ('theof') THEN 'kept_joined' WHEN apart >= 10 * greatest(joined, 1) THEN 'apart'
    WHEN opener_rank <= 30 AND length("left") >= 3 AND length("right") >= 2 THEN 'sentence_opener' END AS reason FROM t)
  SELECT word, reason, coalesce(reason IN ('apart', 'sentence_opener'), false) AS split FROM r
""")
def glued_decisions(t):
    """Over texts into which glue was put: the tables hold none."""
    return forms.decide_glued_splits(forms.count_glued_words(_glued(t), "doc_id"), 10, 30, 3, 2, ["theOf"]).select("word", "reason", "split")


_SPLIT = f"""
  x AS (SELECT text FROM documents),
  v AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents) GROUP BY word),
  k AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM benchmark),
  cuts AS (SELECT word, n AS joined, left(word, i::INT) AS "left", substr(word, i::INT + 1) AS "right" FROM v, unnest(range(1, length(word))) AS u(i) WHERE length(word) >= 4 AND n >= 3),
  c AS MATERIALIZED (SELECT *, "left" IN (SELECT word FROM k) AS left_is_word, "right" IN (SELECT word FROM k) AS right_is_word FROM cuts
        WHERE "left" IN (SELECT word FROM v) AND "right" IN (SELECT word FROM v)),
  {_forms(_HYPHENS, """SELECT "left" || ' ' || "right" AS form FROM c UNION SELECT "left" || '- ' || "right" FROM c UNION SELECT "left" || '-' || "right" FROM c""")},
  t AS (SELECT c.*, coalesce(a.n, 0) AS space, coalesce(b.n, 0) AS hyphen_space, coalesce(d.n, 0) AS hyphen
        FROM c LEFT JOIN f a ON a.form = "left" || ' ' || "right" LEFT JOIN f b ON b.form = "left" || '- ' || "right" LEFT JOIN f d ON d.form = "left" || '-' || "right"
        WHERE NOT (left_is_word AND right_is_word) AND coalesce(a.n, 0) + coalesce(b.n, 0) + coalesce(d.n, 0) > 0)
"""


@query("split_counts", f"WITH {_SPLIT} SELECT word, \"left\", \"right\", left_is_word, right_is_word, joined, space, hyphen_space, hyphen FROM t")
def split_counts(t):
    return forms.count_split_words(t.documents, _dictionary(t), 3)


@query("split_decisions", f"""
  WITH {_SPLIT} SELECT word, "left", "right", joined >= 2 * (space + hyphen_space + hyphen) AS "join",
    joined >= 4 * (space + hyphen_space + hyphen) AND NOT right_is_word AND length("left") >= 2 AND length("right") >= 2 AS join_hyphenated FROM t
""")
def split_decisions(t):
    return forms.decide_split_joins(forms.count_split_words(t.documents, _dictionary(t), 3), 2, 4, []).select("word", "left", "right", "join", "join_hyphenated")


@query("lower_glue", f"""
  WITH x AS (SELECT text FROM documents),
  v AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents) GROUP BY word),
  k AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM benchmark),
  cuts AS (SELECT word, n AS joined, i, left(word, i::INT) AS "left", substr(word, i::INT + 1) AS "right" FROM v, unnest(range(2, length(word) - 1)) AS u(i)
           WHERE length(word) >= 4 AND n >= 3 AND word NOT IN (SELECT word FROM k)),
  {_forms(_HYPHENS, """SELECT "left" || ' ' || "right" AS form FROM cuts""")},
  c AS (SELECT cuts.*, coalesce(f.n, 0) AS apart FROM cuts LEFT JOIN f ON f.form = "left" || ' ' || "right" WHERE "left" IN (SELECT word FROM k) AND "right" IN (SELECT word FROM k))
  SELECT word, joined, "left", "right", apart, apart >= joined AS split FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY apart DESC, i) = 1
""")
def lower_glue(t):
    return forms.decide_lower_glue(forms.count_lower_glue(t.documents, _dictionary(t), 3), 1, [])


@query("phrase_npmi", """
  WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
  s AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM w) GROUP BY x),
  p AS (SELECT a, b, count(*) AS n FROM (SELECT w[i] AS a, w[i + 1] AS b FROM w, unnest(range(1, len(w))) AS u(i)) GROUP BY a, b HAVING count(*) >= 20),
  z AS (SELECT sum(n)::DOUBLE AS total FROM s)
  SELECT p.a, p.b, p.n, round(ln(p.n * total / (x.n * y.n)) / -ln(p.n / total), 6) AS npmi FROM p JOIN s x ON x.x = p.a JOIN s y ON y.x = p.b, z
  WHERE ln(p.n * total / (x.n * y.n)) / -ln(p.n / total) >= 0.3
""")
def phrase_npmi(t):
    out = forms.bigram_npmi(t.documents, T.latin_words(F.col("text")), 20, 0.3)
    return out.withColumn("npmi", F.round("npmi", 6))


# a stand-in for a tagger: every word of four letters or more that ends in -s is read as a plural
_VOTED = """
  v AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents) GROUP BY word),
  k AS MATERIALIZED (SELECT word AS type, n, regexp_matches(word, 's$') AND length(word) > 3 AS is_s FROM v),
  c AS (SELECT type, n, u.place, u.lemma FROM (SELECT type, n, list_filter([{'place': 0, 'lemma': left(type, length(type) - 1)}, {'place': 1, 'lemma': CASE WHEN regexp_matches(type, '(s|x|z|ch|sh|o)es$') THEN left(type, length(type) - 2) END},
      {'place': 2, 'lemma': CASE WHEN regexp_matches(type, 'ies$') THEN left(type, length(type) - 3) || 'y' END}, {'place': 3, 'lemma': CASE WHEN regexp_matches(type, 'ses$') THEN left(type, length(type) - 2) || 'is' END}], lambda x: x.lemma IS NOT NULL AND length(x.lemma) >= 3) AS l FROM k WHERE is_s AND n >= 5), unnest(l) AS w(u)),
  b AS (SELECT c.type, c.n, c.lemma, coalesce(k.n, 0) AS frequency, CASE WHEN NOT k.is_s THEN k.n ELSE 0 END AS read, CASE WHEN c.place = 0 THEN c.n ELSE 0 END AS named, c.place FROM c LEFT JOIN k ON k.type = c.lemma
        QUALIFY row_number() OVER (PARTITION BY c.type ORDER BY coalesce(CASE WHEN NOT k.is_s THEN k.n ELSE 0 END, 0) DESC, coalesce(k.n, 0) DESC, named DESC, c.place) = 1),
  voted AS (SELECT type, lemma, 'plural' AS rule FROM b WHERE coalesce(read, 0) >= 5 OR frequency >= greatest(1.0, 0.1 * n))
"""


@query("lemma_map", f"WITH {_VOTED} SELECT type, lemma, rule FROM voted")
def lemma_map(t):
    words = checkpoint(forms.vocabulary(t.documents))
    return lemmas.voted_lemmas(_votes(words), words)


def _votes(words):
    plural = F.col("word").endswith("s") & (F.length("word") > 3)
    return words.select(F.col("word").alias("type"), F.when(plural, "NNS").otherwise("NN").alias("tag"), F.when(plural, F.expr("left(word, length(word) - 1)")).otherwise(F.col("word")).alias("lemma"), F.col("n").alias("count"))


_SPELLED = " ".join(f"WHEN regexp_matches(w, '{pattern}') THEN regexp_replace(w, '{pattern}', '\\1{new}\\2')" for pattern, _, new in lemmas.spelling_patterns())
_NORMAL = f"""
  {_VOTED},
  dictionary AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM benchmark),
  step AS (SELECT v.word AS type, coalesce(voted.lemma, v.word) AS lemma, voted.rule FROM v LEFT JOIN voted ON voted.type = v.word WHERE regexp_full_match(v.word, '[a-z]+')),
  listed AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in lemmas.SPELLINGS.items())}) AS l(w, there)),
  spelled AS (SELECT w, coalesce(there, CASE WHEN NOT regexp_matches(w, '{lemmas.unchanged_pattern()}') THEN CASE {_SPELLED} END END) AS c FROM (SELECT DISTINCT lemma AS w FROM step WHERE length(lemma) >= 6) LEFT JOIN listed USING (w)),
  american AS (SELECT s.w, s.c FROM spelled s LEFT JOIN v x ON x.word = s.c LEFT JOIN v y ON y.word = s.w LEFT JOIN dictionary d ON d.word = s.c
    WHERE s.c <> s.w AND (d.word IS NOT NULL OR coalesce(x.n, 0) >= 5) AND coalesce(x.n, 0) >= greatest(1.0, 0.1 * coalesce(y.n, 0))),
  links AS (SELECT type, coalesce(c, lemma) AS lemma, coalesce(rule, 'spelling') AS rule FROM step LEFT JOIN american ON w = lemma WHERE type <> coalesce(c, lemma)),
  way AS (SELECT type, lemma, rule, 0 AS k FROM links UNION ALL SELECT way.type, links.lemma, way.rule, k + 1 FROM way JOIN links ON links.type = way.lemma WHERE way.lemma <> way.type AND k < 50),
  normal AS (SELECT type, lemma, rule FROM way WHERE lemma <> type QUALIFY row_number() OVER (PARTITION BY type ORDER BY k DESC) = 1 AND type NOT IN (SELECT type FROM way WHERE lemma = type))
"""


def _normal_forms(t):
    words = checkpoint(forms.vocabulary(t.documents))
    return checkpoint(lemmas.learn_lemma_map(words, _votes(words), _dictionary(t)))


@query("normal_forms", f"WITH RECURSIVE {_NORMAL} SELECT type, lemma, rule FROM normal")
def normal_forms(t):
    """From votes to finished normal forms: American spelling, and chains followed to their end."""
    return _normal_forms(t)


@query("mapped_texts", f"""
  WITH RECURSIVE {_NORMAL}, w AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
  m AS (SELECT doc_id, string_agg(coalesce(lemma, word), ' ' ORDER BY i) AS mapped FROM e LEFT JOIN normal ON type = word WHERE word <> '' GROUP BY doc_id)
  SELECT doc_id, md5(coalesce(mapped, '')) AS mapped FROM documents LEFT JOIN m USING (doc_id)
""")
def mapped_texts(t):
    """Every token of the texts in its normal form."""
    out = lemmas.apply_lemma_map(t.documents.select("doc_id", F.lower("text").alias("text")), "doc_id", "text", _normal_forms(t))
    return out.select("doc_id", F.md5("text").alias("mapped"))


@query("glue_split", f"""
  WITH {_GLUE}, r AS (SELECT word, "left" || ' ' || "right" AS parts FROM t WHERE lower(word) <> 'theof' AND (apart >= 10 * greatest(joined, 1) OR opener_rank <= 30 AND length("left") >= 3 AND length("right") >= 2)),
  w AS (SELECT doc_id, regexp_extract_all(text, '\\p{{L}}+|[^\\p{{L}}]+') AS w FROM x), e AS (SELECT doc_id, i, w[i] AS word FROM w, unnest(range(1, len(w) + 1)) AS u(i))
  SELECT doc_id, count(r.word) AS splits, md5(coalesce(string_agg(coalesce(parts, e.word), '' ORDER BY i), '')) AS repaired FROM e LEFT JOIN r ON r.word = e.word GROUP BY doc_id
""")
def glue_split(t):
    """The decided splits applied: whole words, wherever they stand."""
    glued = checkpoint(_glued(t))
    decided = forms.decide_glued_splits(forms.count_glued_words(glued, "doc_id"), 10, 30, 3, 2, ["theOf"]).where("split")
    out = forms.replace_words(glued, "doc_id", "text", decided.select("word", F.concat_ws(" ", "left", "right").alias("replacement")))
    return out.select("doc_id", "replaced", F.md5("text").alias("repaired")).withColumnRenamed("replaced", "splits")


@query("phrase_tokens")
def phrase_tokens(t):
    """Tokens of every text with the learnt phrases joined."""
    w = T.latin_words(F.col("text"))
    phrases = checkpoint(forms.bigram_npmi(t.documents, w, 20, 0.3).select(F.concat_ws("_", "a", "b").alias("phrase")))
    joined = lemmas.join_phrases(t.documents.select("doc_id", "text"), w, phrases, ["of", "the"])
    return joined.select("doc_id", F.size(w).alias("words"), F.size("joined").alias("tokens"))


@query("repeated_texts", "SELECT md5(text) AS text, count(*) AS n FROM documents GROUP BY text HAVING count(*) >= 2")
def repeated_texts(t):
    return forms.repeated_texts(t.documents, "text", 2).select(F.md5("text").alias("text"), "n")


# pairs of neighbouring words that also stand joined by a hyphen
@query("hyphen_or_space", f"""
  WITH x AS (SELECT text FROM documents),
  c AS MATERIALIZED (SELECT DISTINCT h[1] AS "left", h[2] AS "right" FROM (SELECT string_split(unnest(regexp_extract_all(lower(text), '\\p{{L}}+-\\p{{L}}+')), '-') AS h FROM documents)),
  {_forms(_HYPHENS, """SELECT "left" || ' ' || "right" AS form FROM c UNION SELECT "left" || '-' || "right" FROM c""")}
  SELECT "left", "right", CASE WHEN coalesce(h.n, 0) > coalesce(s.n, 0) THEN '-' ELSE ' ' END AS separator
  FROM c LEFT JOIN f h ON h.form = "left" || '-' || "right" LEFT JOIN f s ON s.form = "left" || ' ' || "right"
""")
def hyphen_or_space(t):
    """For every pair of words that a hyphen joins somewhere."""
    joined = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+-\p{L}+"), F.lit(0))).alias("word"))
    pairs = checkpoint(joined.select(F.split("word", "-").alias("p")).select(F.col("p")[0].alias("left"), F.col("p")[1].alias("right")).distinct())
    written = pairs.select(F.explode(F.array(F.concat("left", F.lit(" "), "right"), F.concat("left", F.lit("-"), "right"))).alias("form"))
    return forms.decide_separators(pairs, checkpoint(forms.count_forms(t.documents, written)))


@query("plain_repair", """
  WITH a AS (SELECT doc_id, text FROM documents), s AS (SELECT doc_id, regexp_replace(text, '[ \t\r\n]+', ' ', 'g') AS text FROM a),
  p AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([\\p{L}\\p{N})\\]]) +([,;])', '\\1\\2', 'g'), '([\\p{L})\\]]) +:', '\\1:', 'g'), '([(\\[]) +([\\p{L}\\p{N}])', '\\1\\2', 'g') AS text FROM s),
  q AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([a-z0-9)\\]])([.?!])([A-Z][a-z])', '\\1\\2 \\3', 'g'), '([A-Za-z]{2}),([A-Za-z])', '\\1, \\2', 'g'), '([A-Za-z0-9)\\]]);([A-Za-z])', '\\1; \\2', 'g') AS text FROM p)
  SELECT doc_id, md5(trim(text, ' ')) AS repaired FROM q
""")
def plain_repair(t):
    return t.documents.select("doc_id", F.md5(T.plain_repair(F.col("text"))).alias("repaired"))
