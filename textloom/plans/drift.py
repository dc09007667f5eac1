"""Drift between cells: here a cell is a source group, or a source and a decade from the text's length."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift
from ..operators.duplicates import checkpoint
from .registry import query

_WORDS_SQL = """
  t AS (SELECT CASE WHEN even THEN 'a' ELSE 'b' END AS cell, word, count(*) AS n FROM (
    SELECT (right(source, 1) IN ('0', '2', '4', '6', '8')) AS even, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents) GROUP BY 1, 2),
  p AS (SELECT word, (sum(n) FILTER (WHERE cell = 'a'))::BIGINT AS count_a, (sum(n) FILTER (WHERE cell = 'b'))::BIGINT AS count_b FROM t GROUP BY word
        HAVING sum(n) FILTER (WHERE cell = 'a') >= 20 AND sum(n) FILTER (WHERE cell = 'b') >= 20),
  g AS (SELECT *, round(abs(ln(count_a / count_b)), 9) AS gap, abs(count_a - count_b)::DOUBLE AS shift FROM p),
  k AS (SELECT *, row_number() OVER (ORDER BY round(ln(count_a::DOUBLE * count_b) / 2, 9), word) AS r, count(*) OVER () AS words FROM g),
  b AS (SELECT word, count_a, count_b, gap, shift, greatest(0, coalesce(ceil((r - 1) * greatest(1, least(10, words // 100)) / nullif(words - 1, 0)) - 1, 0))::INT AS bin FROM k),
  q AS (SELECT *, (rank() OVER (PARTITION BY bin ORDER BY gap) + (count(*) OVER (PARTITION BY bin, gap) - 1) / 2) / count(*) OVER (PARTITION BY bin) * 100 AS gap_percentile,
               (rank() OVER (PARTITION BY bin ORDER BY shift) + (count(*) OVER (PARTITION BY bin, shift) - 1) / 2) / count(*) OVER (PARTITION BY bin) * 100 AS shift_percentile FROM b)
"""


def _pairs(t):
    words = t.documents.select(
        F.when(F.substring("source", -1, 1).isin("0", "2", "4", "6", "8"), "a").otherwise("b").alias("cell"),
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"),
    )
    counts = words.groupBy("cell", "word").agg(F.count("*").alias("n"))
    pairs = drift.compare_cells(counts, "cell", "word", "n", "a", "b", 20)
    return pairs.withColumns({"gap": F.round(F.abs(F.ln(F.col("count_a") / F.col("count_b"))), 9), "shift": F.abs(F.col("count_a") - F.col("count_b")).cast("double")})


@query("frequency_bins", f"WITH {_WORDS_SQL} SELECT word, count_a, count_b, bin FROM b")
def frequency_bins(t):
    return drift.frequency_bins(_pairs(t)).select("word", "count_a", "count_b", "bin")


@query("noise_floor", f"WITH {_WORDS_SQL} SELECT word, bin, round(gap_percentile, 6) AS gap_percentile, round(shift_percentile, 6) AS shift_percentile, gap_percentile > 95 AND shift_percentile > 95 AS is_candidate FROM q")
def noise_floor(t):
    out = drift.add_noise_floor(_pairs(t), ["gap", "shift"])
    return out.select("word", "bin", F.round("gap_percentile", 6).alias("gap_percentile"), F.round("shift_percentile", 6).alias("shift_percentile"), "is_candidate")


@query("shift_floor", f"WITH {_WORDS_SQL} SELECT word, bin, round(shift_percentile, 6) AS shift_percentile, shift_percentile > 95 AS is_candidate FROM q")
def shift_floor(t):
    return drift.add_noise_floor(_pairs(t), ["shift"]).select("word", "bin", F.round("shift_percentile", 6).alias("shift_percentile"), "is_candidate")


@query("movement", f"""
  WITH {_WORDS_SQL}, f AS (SELECT gap_percentile > 95 AS fa, shift_percentile > 95 AS fb, gap, shift FROM q),
  r AS (SELECT *, rank() OVER (ORDER BY gap) + (count(*) OVER (PARTITION BY gap) - 1) / 2 AS ra, rank() OVER (ORDER BY shift) + (count(*) OVER (PARTITION BY shift) - 1) / 2 AS rb FROM f)
  SELECT count(*) AS words, count(*) FILTER (WHERE fb AND NOT fa) AS entering, count(*) FILTER (WHERE fa AND NOT fb) AS leaving,
         round(coalesce(1 - count(*) FILTER (WHERE fa AND fb) / nullif(count(*) FILTER (WHERE fa OR fb), 0), 0), 6) AS flag_turnover, round(1 - corr(ra, rb), 6) AS rank_disagreement FROM r
""")
def movement(t):
    pairs = checkpoint(_pairs(t))
    before, after = (drift.add_noise_floor(pairs, [v]) for v in ("gap", "shift"))
    both = drift.movement(before.withColumnRenamed("gap", "value"), after.withColumn("value", F.col("shift")), "word", "is_candidate", "value")
    return both.withColumns({c: F.round(c, 6) for c in ("flag_turnover", "rank_disagreement")})


def _cells(t):
    """The driver's documents carry no year; one is made from the length of the text."""
    return t.documents.select("source", (F.floor(F.month(F.date_add(F.lit("1970-01-01").cast("date"), F.col("n_chars").cast("int"))) / 2) * 10 + 1900).alias("decade")).distinct()


_CELLS = "c AS (SELECT DISTINCT source, (floor(month(DATE '1970-01-01' + n_chars::INT) / 2) * 10 + 1900)::BIGINT AS decade FROM documents)"


@query("within_field_pairs", f"WITH {_CELLS}, l AS (SELECT source, lag(decade) OVER (PARTITION BY source ORDER BY decade) AS decade_a, decade AS decade_b FROM c) SELECT * FROM l WHERE decade_b - decade_a = 10")
def within_field_pairs(t):
    return drift.within_field_pairs(_cells(t), "source", "decade")


@query("cross_field_pairs", f"WITH {_CELLS} SELECT x.decade, x.source AS field_a, y.source AS field_b FROM c x JOIN c y ON x.decade = y.decade AND x.source < y.source")
def cross_field_pairs(t):
    return drift.cross_field_pairs(_cells(t), "source", "decade")


@query("reliable_transitions", """
  WITH w AS (SELECT (floor(month(DATE '1970-01-01' + n_chars::INT) / 2) * 10 + 1900)::BIGINT AS decade, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents),
  c AS (SELECT word, decade, count(*) AS n FROM w GROUP BY 1, 2), l AS (SELECT *, lag(n) OVER (PARTITION BY word ORDER BY decade) AS before FROM c)
  SELECT word, count(*) FILTER (WHERE before >= 20 AND n >= 20) AS transitions FROM l GROUP BY word
""")
def reliable_transitions(t):
    decade = F.floor(F.month(F.date_add(F.lit("1970-01-01").cast("date"), F.col("n_chars").cast("int"))) / 2) * 10 + 1900
    counts = t.documents.select(decade.alias("decade"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("word", "decade").agg(F.count("*").alias("n"))
    return drift.reliable_transitions(counts, "word", "decade", "n", 20)


_GRID = """
  e AS (SELECT 'c' || vec_id % 3 AS cell, (vec_id // 3)::VARCHAR AS word, 40 + (vec_id * 37) % 300 AS n, embedding::DOUBLE[] AS v FROM embeddings),
  m AS (SELECT a || '-' || b AS pair, x.word, x.n AS count_a, y.n AS count_b, x.v AS va, y.v AS vb FROM (VALUES ('c0', 'c1'), ('c1', 'c2')) p(a, b) JOIN e x ON x.cell = a JOIN e y ON y.cell = b AND y.word = x.word WHERE x.n >= 50 AND y.n >= 50),
  d AS (SELECT x.pair, x.word, y.word AS other, list_dot_product(x.va, y.va) / sqrt(list_dot_product(x.va, x.va) * list_dot_product(y.va, y.va)) AS sa, list_dot_product(x.vb, y.vb) / sqrt(list_dot_product(x.vb, x.vb) * list_dot_product(y.vb, y.vb)) AS sb FROM m x JOIN m y ON x.pair = y.pair AND x.word <> y.word),
  r AS (SELECT pair, word, row_number() OVER (PARTITION BY pair, word ORDER BY sa DESC, other) <= 5 AS a, row_number() OVER (PARTITION BY pair, word ORDER BY sb DESC, other) <= 5 AS b FROM d),
  s AS (SELECT pair, word, 1 - count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a OR b) AS neighbour_shift FROM r GROUP BY pair, word),
  g AS (SELECT m.pair, m.word, count_a, count_b, 1 - list_dot_product(va, vb) / sqrt(list_dot_product(va, va) * list_dot_product(vb, vb)) AS cosine_drift, neighbour_shift FROM m JOIN s ON s.pair = m.pair AND s.word = m.word WHERE count_a >= 100 AND count_b >= 100)
"""


def _grid(t):
    """Vectors dealt to three cells, three to a word; counts are made of their numbers."""
    v = t.embeddings.select(F.concat(F.lit("c"), F.col("vec_id") % 3).alias("cell"), F.floor(F.col("vec_id") / 3).cast("string").alias("word"), (40 + F.col("vec_id") * 37 % 300).alias("n"), F.col("embedding").cast("array<double>").alias("vec"))
    pairs = t.spark.createDataFrame([("c0-c1", "c0", "c1"), ("c1-c2", "c1", "c2")], "pair string, cell_a string, cell_b string")
    return v.select("cell", "word", "n"), v.select("cell", "word", "vec"), pairs


@query("compare_cells", f"WITH {_GRID} SELECT pair, word, count_a, count_b, round(cosine_drift, 6) AS cosine_drift, round(neighbour_shift, 6) AS neighbour_shift FROM g")
def compare_cells(t):
    out = drift.measured_pairs(*_grid(t), k=5, candidate=50, measure=100)
    return out.withColumns({c: F.round(c, 6) for c in ("cosine_drift", "neighbour_shift")})


@query("measure_grid", f"""
  WITH {_GRID}, k AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(ln(count_a::DOUBLE * count_b) / 2, 9), word) AS r, count(*) OVER (PARTITION BY pair) AS words FROM g),
  b AS (SELECT *, greatest(0, coalesce(ceil((r - 1) * greatest(1, least(10, words // 100)) / nullif(words - 1, 0)) - 1, 0))::INT AS bin FROM k),
  q AS (SELECT *, (rank() OVER (PARTITION BY pair, bin ORDER BY cosine_drift) + (count(*) OVER (PARTITION BY pair, bin, cosine_drift) - 1) / 2) / count(*) OVER (PARTITION BY pair, bin) * 100 AS c,
    (rank() OVER (PARTITION BY pair, bin ORDER BY neighbour_shift) + (count(*) OVER (PARTITION BY pair, bin, neighbour_shift) - 1) / 2) / count(*) OVER (PARTITION BY pair, bin) * 100 AS n FROM b)
  SELECT pair, word, bin, round(c, 4) AS cosine_drift_percentile, round(n, 4) AS neighbour_shift_percentile, c > 95 AND n > 95 AS is_candidate, word IN ('7', '11') AS is_target, word IN ('8', '12') AS is_control FROM q
""")
def measure_grid(t):
    out = drift.measure_grid(*_grid(t), ["7", "11"], ["8", "12"], k=5, candidate=50, measure=100)
    return out.select("pair", "word", "bin", *[F.round(c, 4).alias(c) for c in ("cosine_drift_percentile", "neighbour_shift_percentile")], "is_candidate", "is_target", "is_control")


@query("movements", """
  WITH b AS (SELECT p_partkey AS word, p_size > 40 AS f, p_retailprice AS v FROM part), v AS (SELECT r AS replicate, p_partkey AS word, p_size + (p_partkey * r) % 7 > 40 AS f, p_retailprice + (p_partkey * r) % 100 AS v FROM part, unnest(range(1, 6)) AS n(r) WHERE p_partkey % 9 <> r),
  j AS (SELECT x.r AS replicate, b.word, coalesce(b.f, false) AS fa, coalesce(v.f, false) AS fb, b.v AS va, v.v AS vb FROM b CROSS JOIN (SELECT unnest(range(1, 6)) AS r) x LEFT JOIN v ON v.word = b.word AND v.replicate = x.r),
  k AS (SELECT *, CASE WHEN vb IS NOT NULL THEN rank() OVER (PARTITION BY replicate, vb IS NULL ORDER BY va) + (count(*) OVER (PARTITION BY replicate, vb IS NULL, va) - 1) / 2 END AS ra, CASE WHEN vb IS NOT NULL THEN rank() OVER (PARTITION BY replicate, vb IS NULL ORDER BY vb) + (count(*) OVER (PARTITION BY replicate, vb) - 1) / 2 END AS rb FROM j)
  SELECT replicate::INT AS replicate, count(vb) AS words, count(*) FILTER (WHERE fb AND NOT fa) AS entering, count(*) FILTER (WHERE fa AND NOT fb) AS leaving, round(1 - count(*) FILTER (WHERE fa AND fb) / count(*) FILTER (WHERE fa OR fb), 6) AS flag_turnover, round(1 - corr(ra, rb), 6) AS rank_disagreement FROM k GROUP BY replicate
""")
def movements(t):
    """Five changed versions of the parts against the parts themselves; a version lacks some."""
    base = t.part.select(F.col("p_partkey").alias("word"), (F.col("p_size") > 40).alias("f"), F.col("p_retailprice").alias("v"))
    r = F.col("replicate")
    versions = t.part.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(5)))).where(F.col("p_partkey") % 9 != r)
    versions = versions.select("replicate", F.col("p_partkey").alias("word"), (F.col("p_size") + F.col("p_partkey") * r % 7 > 40).alias("f"), (F.col("p_retailprice") + F.col("p_partkey") * r % 100).alias("v"))
    out = drift.movements(base, versions, ["replicate"], "word", "f", "v")
    return out.withColumns({c: F.round(c, 6) for c in ("flag_turnover", "rank_disagreement")})
