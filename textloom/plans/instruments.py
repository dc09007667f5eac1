"""Statistical instruments over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classifier, instruments, quantiles
from ..operators.forms import vocabulary
from .registry import query


@query("auc_of_length", """
  WITH g AS (SELECT lang, n_chars AS s, quality = 1 AS p FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
  SELECT a.lang, round(sum(CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM g a JOIN g b ON a.lang = b.lang AND a.p AND NOT b.p GROUP BY a.lang
""")
def auc_of_length(t):
    rows = t.documents.join(t.labels, "doc_id").where("quality is not null")
    return instruments.auc(rows, "n_chars", F.col("quality") == 1, ["lang"]).where("auc is not null").withColumn("auc", F.round("auc", 6))


@query("exact_quantiles", """
  WITH g AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice::DOUBLE, [0.05, 0.5, 0.975]) AS v FROM lineitem GROUP BY ALL)
  SELECT l_returnflag, l_linestatus, unnest([0.05::DOUBLE, 0.5::DOUBLE, 0.975::DOUBLE]) AS q, round(unnest(v), 4) AS value FROM g
""")
def exact_quantiles(t):
    return quantiles.quantiles(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.05, 0.5, 0.975]).withColumn("value", F.round("value", 4))


def _out_of_fold(t):
    """Two periods of the vectors, made of their labels, told apart by models that didn't see a row's fold."""
    return classifier.out_of_fold(t.embeddings.select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("later")), "vec_id", "embedding", "later", 5, 1.0)


@query("period_classifier_auc")
def period_classifier_auc(t):
    """How well the two periods are told apart, by fold."""
    return classifier.auc(_out_of_fold(t), ["fold"]).withColumn("auc", F.round("auc", 4))


@query("out_of_fold_doubt")
def out_of_fold_doubt(t):
    """Vectors whose label the model of the other folds holds unlikely."""
    return classifier.doubtful(_out_of_fold(t), 0.7).select("vec_id", "y", F.round("doubt", 4).alias("doubt"))


@query("energy_distance", """
  WITH u AS (SELECT vec_id, label < 5 AS f, embedding::DOUBLE[] AS e FROM embeddings),
  d AS (SELECT a.f AS fa, b.f AS fb, 1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS d FROM u a JOIN u b ON a.vec_id < b.vec_id)
  SELECT round(avg(d) FILTER (WHERE fa <> fb), 6) AS across, round(avg(d) FILTER (WHERE fa AND fb), 6) AS within_first, round(avg(d) FILTER (WHERE NOT fa AND NOT fb), 6) AS within_second,
         round(2 * avg(d) FILTER (WHERE fa <> fb) - avg(d) FILTER (WHERE fa AND fb) - avg(d) FILTER (WHERE NOT fa AND NOT fb), 6) AS energy FROM d
""")
def energy_distance(t):
    out = instruments.energy_distance(t.embeddings, F.col("label") < 5, "embedding")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("bootstrap_interval", """
  WITH u AS (SELECT r, n_chars::DOUBLE AS v, ('0x' || substr(sha256(r || ':' || doc_id), 1, 8))::BIGINT / 4294967296 AS u FROM documents, unnest(range(1, 51)) AS x(r)),
  w AS (SELECT r, v, len(list_filter([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]::DOUBLE[], lambda s: u >= s)) AS w FROM u),
  m AS (SELECT r, sum(w * v) / sum(w) AS m FROM w GROUP BY r)
  SELECT round((SELECT avg(n_chars) FROM documents), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m
""")
def bootstrap_interval(t):
    out = instruments.bootstrap_interval(t.documents.select("doc_id", F.col("n_chars").cast("double").alias("v")), "doc_id", "v", 50)
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("stratified_sample", """
  WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents)
  SELECT doc_id, lang, round(n / least(n, 40), 6) AS weight FROM d WHERE place <= 40
""")
def stratified_sample(t):
    return instruments.stratified_sample(t.documents, "doc_id", "lang", 40).withColumn("weight", F.round("weight", 6))


@query("matched_controls", """
  WITH v AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents) GROUP BY word),
  p AS (SELECT a.word AS target, b.word AS control, greatest(abs(b.n - a.n) / a.n, 0.0) AS gap FROM v a, v b WHERE a.word IN ('that', 'with', 'der') AND b.word NOT IN ('that', 'with', 'der'))
  SELECT target, control, round(gap, 6) AS gap FROM p QUALIFY row_number() OVER (PARTITION BY target ORDER BY gap, control) <= 10
""")
def matched_controls(t):
    targets = t.spark.createDataFrame([("that",), ("with",), ("der",)], "word string")
    return instruments.matched_controls(vocabulary(t.documents), targets, "word", ["n"], 10).withColumn("gap", F.round("gap", 6))


@query("leave_one_out_bars", """
  WITH s AS (SELECT source, avg(n_chars) AS v FROM documents GROUP BY source), q AS (SELECT a.source, quantile_cont(b.v, 0.95) AS q FROM s a JOIN s b ON a.source <> b.source GROUP BY a.source)
  SELECT round(min(q), 4) AS least, round(max(q), 4) AS greatest FROM q
""")
def leave_one_out_bars(t):
    means = t.documents.groupBy("source").agg(F.avg("n_chars").alias("v"))
    out = instruments.leave_one_out_bars(means, "source", "v", 0.95)
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("majority_lemmas", "SELECT p_brand, round(sum(p_size * (p_type = 'LARGE')::INT) / sum(p_size), 6) AS share FROM part GROUP BY p_brand HAVING sum(p_size * (p_type = 'LARGE')::INT) / sum(p_size) >= 0.15")
def majority_lemmas(t):
    return instruments.majority_lemmas(t.part, "p_brand", "p_size", F.col("p_type") == "LARGE", 0.15).withColumn("share", F.round("share", 6))


@query("thin_cells", "SELECT source, lang, count(*) FILTER (WHERE regexp_matches(lower(text), '(^|[^\\p{L}])license([^\\p{L}]|$)')) AS lines FROM documents GROUP BY source, lang HAVING count(*) FILTER (WHERE regexp_matches(lower(text), '(^|[^\\p{L}])license([^\\p{L}]|$)')) < 2")
def thin_cells(t):
    return instruments.thin_cells(t.documents, ["source", "lang"], "text", "license", 2)


@query("first_encodings", "SELECT doc_id, substr(sha256(text), 1, 20) AS digest, row_number() OVER (PARTITION BY substr(sha256(text), 1, 20) ORDER BY doc_id) = 1 AS encodes FROM documents")
def first_encodings(t):
    return instruments.first_encodings(t.documents, "text", ["doc_id"]).select("doc_id", "digest", "encodes")


@query("classify_vectors")
def classify_vectors(t):
    """Labels of all vectors by a classifier whose seeds are the vectors with a hash in the lowest quarter."""
    seeds = t.embeddings.where(F.substring(F.sha2(F.col("vec_id").cast("string"), 256), 1, 1) < "4").withColumn("name", F.col("label").cast("string"))
    out = instruments.classify(seeds, "name", t.embeddings, "embedding")
    return out.groupBy("label", "prediction").agg(F.count("*").alias("n"))


_UNITS = "u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)"
_HASH = "('0x' || substr(sha256({}), 1, 8))::BIGINT"


@query("two_samples", f"""
  WITH {_UNITS}, d AS (SELECT 0 AS r, CASE WHEN label < 5 THEN 1 ELSE 2 END AS sample, vec_id, u FROM u),
  m AS (SELECT avg(1 - list_dot_product(a.u, b.u)) FILTER (WHERE a.sample <> b.sample) AS across, (avg(1 - list_dot_product(a.u, b.u)) FILTER (WHERE a.sample = 1 AND b.sample = 1) + avg(1 - list_dot_product(a.u, b.u)) FILTER (WHERE a.sample = 2 AND b.sample = 2)) / 2 AS within
    FROM d a JOIN d b ON a.vec_id < b.vec_id)
  SELECT round(across, 6) AS across, round(within, 6) AS within, round(across - within, 6) AS j, round((across - within) / within, 6) AS ratio FROM m
""")
def two_samples(t):
    out = instruments.two_samples(t.embeddings, F.col("label") < 5, "embedding")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def _j_sql(rows: str) -> str:
    return f"""
  WITH {_UNITS}, {rows},
  m AS (SELECT a.r, sum(a.w * b.w * (1 - list_dot_product(a.u, b.u))) FILTER (WHERE a.sample <> b.sample) / sum(a.w * b.w) FILTER (WHERE a.sample <> b.sample) AS across,
    sum(a.w * b.w * (1 - list_dot_product(a.u, b.u))) FILTER (WHERE a.sample = 1 AND b.sample = 1) / sum(a.w * b.w) FILTER (WHERE a.sample = 1 AND b.sample = 1) AS in1,
    sum(a.w * b.w * (1 - list_dot_product(a.u, b.u))) FILTER (WHERE a.sample = 2 AND b.sample = 2) / sum(a.w * b.w) FILTER (WHERE a.sample = 2 AND b.sample = 2) AS in2
    FROM d a JOIN d b ON a.r = b.r AND a.vec_id < b.vec_id GROUP BY a.r), j AS (SELECT r, across - (in1 + in2) / 2 AS j FROM m)"""


@query("j_interval", _j_sql(f"""
  x AS (SELECT r, vec_id, CASE WHEN label < 5 THEN 1 ELSE 2 END AS sample, u, CASE WHEN r = 0 THEN 1 ELSE len(list_filter([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]::DOUBLE[], lambda s: {_HASH.format("r || ':' || vec_id")} / 4294967296 >= s)) END AS w
    FROM u, unnest(range(0, 21)) AS n(r)), d AS (SELECT * FROM x WHERE w > 0)""") + """
  SELECT round(max(j) FILTER (WHERE r = 0), 6) AS j, round(quantile_cont(j, 0.025) FILTER (WHERE r > 0), 6) AS low, round(quantile_cont(j, 0.975) FILTER (WHERE r > 0), 6) AS high FROM j
""")
def j_interval(t):
    out = instruments.j_interval(instruments.j_replicates(t.embeddings, "vec_id", F.col("label") < 5, "embedding", 20))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("j_jackknife", f"""
  WITH {_UNITS}, d AS (SELECT vec_id, label < 5 AS f, u FROM u), p AS (SELECT a.vec_id, a.f, a.f = b.f AS same, 1 - list_dot_product(a.u, b.u) AS d FROM d a JOIN d b ON a.vec_id <> b.vec_id),
  r AS (SELECT vec_id, any_value(f) AS f, sum(d) FILTER (WHERE same) AS own, sum(d) FILTER (WHERE NOT same) AS other FROM p GROUP BY vec_id),
  s AS (SELECT f, count(*) AS n, sum(own) / 2 AS within, sum(other) AS across FROM r GROUP BY f)
  SELECT vec_id, round((a.across - r.other) / ((a.n - 1) * b.n) - ((a.within - r.own) / ((a.n - 1) * (a.n - 2) / 2) + b.within / (b.n * (b.n - 1) / 2)) / 2, 6) AS j FROM r JOIN s a ON a.f = r.f JOIN s b ON b.f <> r.f
""")
def j_jackknife(t):
    return instruments.j_jackknife(t.embeddings, "vec_id", F.col("label") < 5, "embedding").withColumn("j", F.round("j", 6))


@query("split_half_null", _j_sql(f"""
  d AS (SELECT r, vec_id, u, 1 AS w, CASE WHEN row_number() OVER (PARTITION BY r ORDER BY {_HASH.format("r || ':' || vec_id")}, vec_id) <= count(*) OVER (PARTITION BY r) // 2 THEN 1 ELSE 2 END AS sample FROM u, unnest(range(1, 21)) AS n(r))""") + """
  SELECT r::INT AS replicate, round(j, 6) AS j FROM j
""")
def split_half_null(t):
    return instruments.split_half_null(t.embeddings, "vec_id", "embedding", 20).withColumn("j", F.round("j", 6))


@query("spread_bands", """
  WITH s AS (SELECT source, avg(n_chars) AS v FROM documents GROUP BY source), t AS (SELECT source AS target, v AS t FROM s WHERE source IN (SELECT source FROM s ORDER BY source LIMIT 2))
  SELECT target, count(*) AS controls, round(avg((abs(v - t) <= 0.25 * abs(t))::INT), 6) AS within_25, round(avg((abs(v - t) <= 0.5 * abs(t))::INT), 6) AS within_50 FROM s, t WHERE source NOT IN (SELECT target FROM t) GROUP BY target
""")
def spread_bands(t):
    means = t.documents.groupBy("source").agg(F.avg("n_chars").alias("v"))
    targets = sorted(r.source for r in means.select("source").collect())[:2]  # names of sources
    out = instruments.spread_bands(means, "source", "v", targets)
    return out.withColumns({c: F.round(c, 6) for c in ("within_25", "within_50")})


@query("stratified_estimate", """
  WITH d AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents), s AS (SELECT *, n / least(n, 40) AS w FROM d WHERE place <= 40)
  SELECT round(sum(w * (n_chars > 1000)::INT) / sum(w), 6) AS estimate, round(sum(w) * sum(w) / sum(w * w), 4) AS effective, count(*) AS labelled FROM s
""")
def stratified_estimate(t):
    sample = instruments.stratified_sample(t.documents, "doc_id", "lang", 40).join(t.documents.select("doc_id", "n_chars"), "doc_id")
    out = instruments.stratified_estimate(sample, "weight", F.col("n_chars") > 1000)
    return out.select(F.round("estimate", 6).alias("estimate"), F.round("effective", 4).alias("effective"), "labelled")


@query("verdicts", """
  WITH b AS (SELECT c_nationkey AS k, list_sort(list(c_acctbal ORDER BY c_custkey)) AS v FROM customer GROUP BY c_nationkey), x AS (SELECT k, v, list_sum(v) / len(v) * 1.8 AS treatment FROM b)
  SELECT k, (1 + len(list_filter(v, lambda p: p >= treatment))) / (len(v) + 1) <= 0.05 AND treatment >= (v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 4 AS verdict FROM x
""")
def verdicts(t):
    """Nations as measurements: their customers' balances are placebos and bootstraps at once, 1.8 times the mean the treatment."""
    return instruments.verdicts(t.customer.select(F.col("c_nationkey").alias("k"), "c_acctbal"), ["k"], "c_acctbal", F.avg("c_acctbal") * 1.8)


@query("kernel_distances", f"""
  WITH {_UNITS}, s AS (SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 2 END AS s, u FROM u), d AS (SELECT a.vec_id AS i, b.vec_id AS j, a.s AS sa, b.s AS sb, 1 - list_dot_product(a.u, b.u) AS d FROM s a, s b),
  w AS (SELECT median(d) AS w FROM d WHERE NOT (sa = 2 AND sb = 1)), m AS (SELECT sa + sb AS p, avg(sqrt(greatest(2 * d, 0))) AS e, avg(exp(-d / w)) AS k FROM d, w WHERE i < j GROUP BY 1)
  SELECT round(2 * any_value(e) FILTER (WHERE p = 3) - any_value(e) FILTER (WHERE p = 2) - any_value(e) FILTER (WHERE p = 4), 6) AS energy,
         round(any_value(k) FILTER (WHERE p = 2) + any_value(k) FILTER (WHERE p = 4) - 2 * any_value(k) FILTER (WHERE p = 3), 6) AS mmd FROM m
""")
def kernel_distances(t):
    out = instruments.kernel_distances(t.embeddings, "vec_id", F.col("label") < 5, "embedding")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
