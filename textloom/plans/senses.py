"""Senses, agreement, samples and resampling over ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample, senses
from ..operators.cleaning import repeated_sentences, sentence_rows
from ..operators.duplicates import checkpoint
from .registry import query

#: Stand-ins for sense cues: the corpus's words are invented.
CUES = {"near": ["<the", "!der"], "far": [">of", ">>of"], "close": ["<<and"]}
TARGET = "that"

_PLACES = f"""
  w AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents),
  o AS (SELECT doc_id, source, w[greatest(i - 5, 1):i - 1] AS l, w[i + 1:i + 5] AS r FROM w, unnest(range(1, len(w) + 1)) AS u(i) WHERE w[i] = '{TARGET}'),
  f AS (SELECT doc_id, source, list_contains(l, 'the') AND NOT (list_contains(l, 'der') OR list_contains(r, 'der')) AS near_, list_contains(r, 'of') OR coalesce(r[1] = 'of', false) AS far_, coalesce(l[-1] = 'and', false) AS close_ FROM o),
  s AS (SELECT doc_id, source, CASE WHEN near_::INT + far_::INT + close_::INT = 1 THEN CASE WHEN near_ THEN 'near' WHEN far_ THEN 'far' ELSE 'close' END END AS sense FROM f)
"""


def _near(t):
    """Every place of the target word with its five words on either side."""
    n = 5
    words = t.documents.select("doc_id", "source", F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)).alias("w"))
    at = words.select("doc_id", "source", "w", F.explode(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: F.get(F.col("w"), i - 1) == TARGET)).alias("i"))
    left = F.slice("w", F.greatest(F.col("i") - n, F.lit(1)), F.least(F.col("i") - 1, F.lit(n)))
    right = F.slice("w", F.col("i") + 1, F.lit(n))
    return at.select("doc_id", "source", left.alias("l"), right.alias("r"))


def _senses(t):
    return _near(t).select("doc_id", "source", senses.cue_sense(CUES, F.col("l"), F.col("r")).alias("sense"))


@query("cue_senses", f"WITH {_PLACES} SELECT doc_id, sense, count(*) AS places FROM s GROUP BY doc_id, sense")
def cue_senses(t):
    return _senses(t).groupBy("doc_id", "sense").agg(F.count("*").alias("places"))


_SHARES = f"{_PLACES}, d AS (SELECT source, sense, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY source) AS share FROM s WHERE sense IS NOT NULL GROUP BY source, sense)"


@query("sense_shares", f"WITH {_SHARES} SELECT source, sense, n, round(share, 6) AS share FROM d")
def sense_shares(t):
    return senses.shares(_senses(t), "source", "sense").withColumn("share", F.round("share", 6))


@query("js_divergence", f"""
  WITH {_SHARES}, x AS (SELECT c.source, l.sense, coalesce(d.share, 0) AS p FROM (SELECT DISTINCT source FROM d) c, (SELECT DISTINCT sense FROM d) l LEFT JOIN d ON d.source = c.source AND d.sense = l.sense)
  SELECT a.source AS cell_a, b.source AS cell_b, round(sum(CASE WHEN a.p > 0 THEN a.p * log2(2 * a.p / (a.p + b.p)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p * log2(2 * b.p / (a.p + b.p)) ELSE 0 END) / 2, 6) AS divergence
  FROM x a JOIN x b ON a.sense = b.sense AND a.source < b.source GROUP BY 1, 2
""")
def js_divergence(t):
    out = senses.divergences(checkpoint(senses.shares(_senses(t), "source", "sense")), "source", "sense")
    return out.withColumn("divergence", F.round("divergence", 6))


_GUESS = "g AS (SELECT quality, toxic, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS guess FROM documents JOIN labels USING (doc_id))"


def _guesses(t):
    return t.documents.join(t.labels, "doc_id").select("quality", "toxic", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("guess"))


@query("confusion", f"WITH {_GUESS} SELECT quality AS truth, guess AS predicted, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM g WHERE quality IS NOT NULL GROUP BY 1, 2")
def confusion(t):
    return senses.confusion(_guesses(t), "quality", "guess").withColumn("share", F.round("share", 6))


# two labels: the equations have one solution; where it has a negative share, that is 0 and the other is all
@query("adjusted_shares", f"""
  WITH {_GUESS}, k AS (SELECT quality, guess FROM g), m AS (SELECT quality AS t, avg(guess) AS m1 FROM k WHERE quality IS NOT NULL GROUP BY quality), y AS (SELECT avg(guess) AS y1 FROM k),
  x AS (SELECT (y1 - a.m1) / (b.m1 - a.m1) AS x1 FROM y, m a, m b WHERE a.t = 0 AND b.t = 1)
  SELECT label, round(CASE label WHEN '1' THEN least(1.0, greatest(0.0, x1)) ELSE 1 - least(1.0, greatest(0.0, x1)) END, 6) AS share FROM x, (SELECT unnest(['0', '1']) AS label)
""")
def adjusted_shares(t):
    g = checkpoint(_guesses(t).select(F.col("quality").cast("string").alias("quality"), F.col("guess").cast("string").alias("guess")))
    observed = senses.shares(g.withColumn("cell", F.lit(1)), "cell", "guess").select(F.col("guess").alias("label"), "share")
    return senses.adjusted_shares(senses.confusion(g, "quality", "guess"), observed).withColumn("share", F.round("share", 6))


@query("agreement", f"""
  WITH {_GUESS}, t AS (SELECT quality AS a, guess AS b, count(*) AS n FROM g WHERE quality IS NOT NULL GROUP BY 1, 2),
  x AS (SELECT sum(n)::BIGINT AS items, sum(n) FILTER (WHERE a = b) AS same, sum(n * (n - 1) / 2) AS together FROM t),
  pa AS (SELECT sum(n * (n - 1) / 2) AS pa FROM (SELECT a, sum(n) AS n FROM t GROUP BY a)), pb AS (SELECT sum(n * (n - 1) / 2) AS pb FROM (SELECT b, sum(n) AS n FROM t GROUP BY b)),
  c AS (SELECT sum(x.n * y.n) AS chance FROM (SELECT a, sum(n) AS n FROM t GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM t GROUP BY b) y ON x.a = y.b)
  SELECT items, round(same / items, 6) AS exact, round((same / items - chance / (items * items)) / (1 - chance / (items * items)), 6) AS kappa,
         round((together - pa * pb / (items * (items - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (items * (items - 1) / 2)), 6) AS adjusted_rand FROM x, pa, pb, c
""")
def agreement(t):
    out = senses.agreement(_guesses(t), "quality", "guess")
    return out.withColumns({c: F.round(c, 6) for c in ("exact", "kappa", "adjusted_rand")})


@query("sample_occurrences", """
  SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('0:' || doc_id)) AS place FROM documents
    WHERE regexp_matches(lower(text), '(^|[^\\p{L}])license([^\\p{L}]|$)')) WHERE place <= 3
""")
def sample_occurrences(t):
    return senses.sample_occurrences(t.documents, "doc_id", "source", "text", "license", 3).select("source", "doc_id")


@query("drop_shared", """
  SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, min(l_returnflag) OVER w AS a, max(l_returnflag) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, year(l_shipdate))) WHERE a = b
""")
def drop_shared(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", F.year("l_shipdate").alias("yr"))
    return senses.drop_shared(rows, "l_orderkey", "l_returnflag", "yr").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("chunk_budget", """
  SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 100000
""")
def chunk_budget(t):
    return senses.chunk_budget(t.documents, "doc_id", "n_chars", "lang", 100_000).select("doc_id")


_HASH = "('0x' || substr(sha256({}), 1, 8))::BIGINT"


@query("bootstrap", f"""
  WITH p AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents),
  d AS (SELECT lang, r AS replicate, {_HASH.format("lang || ':' || r || ':' || place")} % n AS place FROM p, unnest(range(1, 10)) AS u(r)),
  c AS (SELECT lang, replicate, place, count(*) AS times FROM d GROUP BY 1, 2, 3)
  SELECT c.lang, c.replicate::INT AS replicate, doc_id, times FROM c JOIN p ON p.lang = c.lang AND p.place = c.place
""")
def bootstrap(t):
    return resample.bootstrap(t.documents, "doc_id", "lang", 9)


_NULLS = f"""
  b AS (SELECT doc_id, quality = 1 AS f, n_chars::DOUBLE AS v FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
  d AS (SELECT r AS replicate, v, row_number() OVER (PARTITION BY r ORDER BY {_HASH.format("r || ':' || doc_id")}, doc_id) <= (SELECT count(*) FILTER (WHERE f) FROM b) AS f FROM b, unnest(range(1, 21)) AS u(r)),
  n AS (SELECT 0 AS replicate, avg(v) FILTER (WHERE f) - avg(v) FILTER (WHERE NOT f) AS gap FROM b UNION ALL SELECT replicate, avg(v) FILTER (WHERE f) - avg(v) FILTER (WHERE NOT f) FROM d GROUP BY replicate)
"""


def _gaps(t):
    rows = t.documents.join(t.labels, "doc_id").where("quality is not null")
    return resample.permutation_null(rows, "doc_id", F.col("quality") == 1, F.col("n_chars").cast("double"), 20)


@query("permutation_null", f"WITH {_NULLS} SELECT replicate::INT AS replicate, round(gap, 4) AS gap FROM n")
def permutation_null(t):
    return _gaps(t).withColumn("gap", F.round("gap", 4))


@query("rank_test", f"WITH {_NULLS} SELECT round((1 + count(*) FILTER (WHERE abs(gap) >= (SELECT abs(gap) FROM n WHERE replicate = 0))) / (1 + count(*)), 6) AS p FROM n WHERE replicate > 0")
def rank_test(t):
    return resample.rank_test(checkpoint(_gaps(t))).withColumn("p", F.round("p", 6))


@query("placebo_drops", f"""
  WITH d AS (SELECT doc_id, lang <> 'en' AS was_dropped, ntile(10) OVER (ORDER BY n_chars, doc_id) AS decile FROM documents),
  w AS (SELECT decile, count(*) FILTER (WHERE was_dropped) AS wanted FROM d GROUP BY decile),
  p AS (SELECT doc_id, decile, row_number() OVER (PARTITION BY decile ORDER BY {_HASH.format("'1:' || doc_id")}, doc_id) AS place FROM d)
  SELECT doc_id, p.decile::INT AS decile FROM p JOIN w ON w.decile = p.decile WHERE place <= wanted
""")
def placebo_drops(t):
    return resample.placebo_drops(t.documents, "doc_id", "n_chars", F.col("lang") != "en", 1)


@query("planted_change", f"""
  WITH s AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'cell' WHEN lang = 'de' THEN 'donor' END AS side FROM documents),
  p AS (SELECT doc_id, side, row_number() OVER (PARTITION BY side ORDER BY {_HASH.format("'plant:' || doc_id")}, doc_id) AS place FROM s WHERE side IS NOT NULL)
  SELECT a.doc_id, b.doc_id AS replaced_by FROM p a JOIN p b ON a.place = b.place AND a.side = 'cell' AND b.side = 'donor' WHERE a.place <= (SELECT floor(0.1::DOUBLE * count(*)) FROM p WHERE side = 'cell')
""")
def planted_change(t):
    return resample.planted_change(t.documents, "doc_id", F.col("lang") == "en", F.col("lang") == "de", 0.1)


@query("kept_segments", """
  WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])([ \n]+)', '\\1\\2' || chr(1), 'g'), chr(1)) AS w FROM documents),
  e AS (SELECT doc_id, i, w[i] AS piece, regexp_replace(w[i], '([.!?])[ \n]+$', '\\1') AS sentence FROM p, unnest(range(1, len(w) + 1)) AS u(i)),
  o AS (SELECT doc_id, sentence, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece))::BIGINT AS s, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY i) AS copy FROM e),
  t AS (SELECT doc_id, s, s + length(sentence) AS e, copy FROM o WHERE sentence <> ''),
  n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS is_new FROM t WHERE copy > 1),
  i AS (SELECT *, sum(is_new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n),
  m AS (SELECT doc_id, island, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, island),
  k AS (SELECT t.doc_id, t.s, count(m.s) FILTER (WHERE m.e <= t.s) AS segment, count(m.s) FILTER (WHERE t.s < m.e AND t.e > m.s) AS inside FROM t LEFT JOIN m ON m.doc_id = t.doc_id GROUP BY t.doc_id, t.s)
  SELECT doc_id, segment::INT AS segment, min(s) AS first, count(*) AS tokens FROM k WHERE inside = 0 GROUP BY doc_id, segment
""")
def kept_segments(t):
    """Token runs between the ranges of repeated sentences."""
    ranges = resample.merge_ranges(repeated_sentences(sentence_rows(t.documents, "doc_id"), "doc_id").select("doc_id", "start", "end"), "doc_id")
    words = sentence_rows(t.documents, "doc_id").select("doc_id", F.col("start").alias("at"), "start", "end")
    return resample.kept_segments(words, "doc_id", ranges)


@query("merged_ranges", """
  WITH r AS (SELECT l_orderkey, (l_partkey % 50)::BIGINT AS s, (l_partkey % 50 + l_quantity)::BIGINT AS e FROM lineitem),
  n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS is_new FROM r),
  i AS (SELECT *, sum(is_new) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n)
  SELECT l_orderkey, min(s) AS "start", max(e) AS "end" FROM i GROUP BY l_orderkey, island
""")
def merged_ranges(t):
    r = t.lineitem.select("l_orderkey", (F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + F.col("l_quantity")).cast("bigint").alias("end"))
    return resample.merge_ranges(r, "l_orderkey")


@query("with_replacement", f"""
  WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM documents),
  d AS (SELECT source, i AS draw, {_HASH.format("source || ':' || i")} % n AS place FROM (SELECT DISTINCT source, n FROM p), unnest(range(1, 8)) AS u(i))
  SELECT d.source, draw::INT AS draw, doc_id FROM d JOIN p ON p.source = d.source AND p.place = d.place
""")
def with_replacement(t):
    return resample.with_replacement(t.documents, "doc_id", "source", 7)


@query("placebo_passages", f"""
  WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '\\p{{L}}+')) AS n, (doc_id % 40)::BIGINT AS r FROM documents), h AS (SELECT doc_id, n, least(r, n) AS r, {_HASH.format("'3:' || doc_id")} % (n - least(r, n) + 1) AS first FROM n WHERE r > 0 AND n > 0)
  SELECT doc_id, first, first + r AS "end" FROM h
""")
def placebo_passages(t):
    words = t.documents.select("doc_id", F.regexp_count("text", F.lit(r"\p{L}+")).cast("long").alias("n"), (F.col("doc_id") % 40).alias("r"))
    return resample.placebo_passages(words, "doc_id", "n", "r", 3)


@query("version_lines", """
  WITH e AS (SELECT doc_id, i - 1 AS pos, w[i] AS token FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE lang <> 'de'), unnest(range(1, len(w) + 1)) AS u(i)),
  k AS (SELECT *, (pos // 50) AS segment FROM e WHERE pos % 50 < 45)
  SELECT doc_id, segment::INT AS segment, md5(string_agg(token, ' ' ORDER BY pos)) AS line FROM k GROUP BY doc_id, segment
""")
def version_lines(t):
    """The last five of every fifty tokens are cut, and one language's documents are dropped."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    tokens = t.documents.select("doc_id", F.posexplode(w).alias("at", "token")).select("doc_id", "at", F.col("at").cast("long").alias("start"), (F.col("at") + 1).cast("long").alias("end"), "token")
    cuts = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.size(w) / 50).cast("int"))).alias("k")).select("doc_id", (F.col("k") * 50 + 45).cast("long").alias("start"), (F.col("k") * 50 + 50).cast("long").alias("end"))
    out = resample.version_lines(tokens, "doc_id", cuts, t.documents.where("lang = 'de'"))
    return out.select("doc_id", "segment", F.md5("line").alias("line"))


@query("sample_many", """
  WITH w AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents)
  SELECT word, source, doc_id FROM w WHERE word IN ('the', 'der', 'license') QUALIFY row_number() OVER (PARTITION BY word, source ORDER BY sha256('0:' || doc_id)) <= 2
""")
def sample_many(t):
    words = t.spark.createDataFrame([("the",), ("der",), ("license",)], "word string")
    return senses.sample_many(t.documents, "doc_id", "source", "text", words, 2)


@query("spearman", """
  WITH d AS (SELECT lang, n_chars, length(source) + doc_id % 7 AS v FROM documents), r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS ra, rank() OVER (PARTITION BY lang ORDER BY v) + (count(*) OVER (PARTITION BY lang, v) - 1) / 2 AS rb FROM d)
  SELECT lang, count(*) AS items, round(corr(ra, rb), 6) AS rho FROM r GROUP BY lang
""")
def spearman(t):
    rows = t.documents.select("lang", "n_chars", (F.length("source") + F.col("doc_id") % 7).alias("v"))
    return senses.spearman(rows, "n_chars", "v", ["lang"]).withColumn("rho", F.round("rho", 6))


@query("repeat_consistency", """
  SELECT count(*) AS items, round(avg((k = 1)::INT), 6) AS consistent FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY l_orderkey) WHERE n > 1
""")
def repeat_consistency(t):
    return senses.repeat_consistency(t.lineitem, "l_orderkey", "l_returnflag").withColumn("consistent", F.round("consistent", 6))


@query("leave_one_cue_out", f"""
  WITH {_PLACES},
  v AS (SELECT doc_id, u.cue, u.sense AS of_, near_::INT + far_::INT + close_::INT AS fired, CASE WHEN near_ THEN 'near' WHEN far_ THEN 'far' WHEN close_ THEN 'close' END AS any_, near_, far_, close_, l, r FROM
    (SELECT o.doc_id, list_contains(l, 'the') AND NOT (list_contains(l, 'der') OR list_contains(r, 'der')) AS near_, list_contains(r, 'of') OR coalesce(r[1] = 'of', false) AS far_, coalesce(l[-1] = 'and', false) AS close_, l, r FROM o),
    unnest([{{'sense': 'near', 'cue': '<the'}}, {{'sense': 'near', 'cue': '!der'}}, {{'sense': 'far', 'cue': '>of'}}, {{'sense': 'far', 'cue': '>>of'}}, {{'sense': 'close', 'cue': '<<and'}}]) AS w(u)),
  n AS (SELECT *, CASE cue WHEN '<the' THEN false WHEN '!der' THEN list_contains(l, 'the') ELSE near_ END AS n2, CASE cue WHEN '>of' THEN coalesce(r[1] = 'of', false) WHEN '>>of' THEN list_contains(r, 'of') ELSE far_ END AS f2, CASE cue WHEN '<<and' THEN false ELSE close_ END AS c2 FROM v),
  z AS (SELECT of_, cue, CASE WHEN fired = 1 THEN any_ END AS was, CASE WHEN n2::INT + f2::INT + c2::INT = 1 THEN CASE WHEN n2 THEN 'near' WHEN f2 THEN 'far' ELSE 'close' END END AS now_ FROM n)
  SELECT of_ AS sense, cue, count(was) AS places, count(*) FILTER (WHERE was IS DISTINCT FROM now_) AS changed FROM z GROUP BY 1, 2
""")
def leave_one_cue_out(t):
    return senses.leave_one_cue_out(_near(t), CUES, "l", "r")
