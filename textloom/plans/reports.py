"""Report sections over a build of ``documents``, and the comparison of two builds with different thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning, report
from ..operators.duplicates import checkpoint
from .registry import SENTENCES, WORDS, query


def _build(t, min_works: int, least_words: int):
    """Works dropped as short or template, with the template sentences as removals and two flags."""
    none, ranges = F.array().cast("array<string>"), F.array().cast("array<struct<start:bigint,end:bigint,reason:string>>")
    short = F.size(T.words(F.col("text"))) < least_words
    works = t.documents.select(F.col("doc_id").alias("work"), "text", "source", "lang", none.alias("flags"), ranges.alias("removals"), F.when(short, "short").alias("dropped_reason"))
    works = cleaning.mark_templates(works, "work", min_works)
    flags = F.filter(F.array(F.when(F.col("lang") != "en", F.lit("other_language")), F.when(T.ends_mid_sentence(F.col("text")), F.lit("truncated"))), lambda f: f.isNotNull())
    return checkpoint(works.withColumn("flags", flags))


def _sql(name: str, min_works: int, least_words: int) -> str:
    """The same build: ``name`` with outcomes and flags, ``name``_r with its ranges."""
    return f"""
  {name}_k AS (SELECT doc_id, text, source, lang, CASE WHEN len(list_filter(string_split_regex(text, '[ \n]+'), lambda w: w <> '')) < {least_words} THEN 'short' END AS short FROM documents),
  {name}_p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])([ \n]+)', '\\1\\2' || chr(1), 'g'), chr(1)) AS w FROM {name}_k WHERE short IS NULL),
  {name}_e AS (SELECT doc_id, i, w[i] AS piece, regexp_replace(w[i], '([.!?])[ \n]+$', '\\1') AS sentence FROM {name}_p, unnest(range(1, len(w) + 1)) AS u(i)),
  {name}_o AS (SELECT doc_id, sentence, regexp_replace(sentence, '[0-9]+', '0', 'g') AS masked, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece))::BIGINT AS s FROM {name}_e),
  {name}_m AS (SELECT masked FROM {name}_o WHERE sentence <> '' GROUP BY masked HAVING count(DISTINCT doc_id) >= {min_works}),
  {name}_r AS (SELECT doc_id, s, s + length(sentence) AS e FROM {name}_o SEMI JOIN {name}_m USING (masked) WHERE sentence <> ''),
  {name}_t AS (SELECT doc_id FROM {name}_o WHERE sentence <> '' GROUP BY doc_id HAVING coalesce(sum(length(sentence)) FILTER (WHERE masked IN (FROM {name}_m)), 0) / sum(length(sentence)) > 0.5),
  {name} AS (SELECT doc_id, text, source, lang, coalesce(short, CASE WHEN doc_id IN (FROM {name}_t) THEN 'template' END) AS dropped_reason,
    lang <> 'en' AS f1, regexp_replace(regexp_replace(text, '[ \n]+$', ''), '[)\\]}}"''”’» ]+$', '') AS ending FROM {name}_k),
  {name}_f AS (SELECT doc_id, lang, unnest(list_filter([CASE WHEN f1 THEN 'other_language' END, CASE WHEN ending <> '' AND right(ending, 1) NOT IN ('.', '!', '?') THEN 'truncated' END], lambda x: x IS NOT NULL)) AS flag FROM {name})"""


A, B = (20, 5), (10, 20)
_A, _B = _sql("a", *A), _sql("b", *B)


@query("report_totals", f"WITH {_A} SELECT count(*) AS works, count(*) FILTER (WHERE dropped_reason IS NULL) AS kept, count(dropped_reason) AS dropped FROM a")
def report_totals(t):
    return report.totals(_build(t, *A))


@query("report_dropped_by_language", f"WITH {_B} SELECT lang, count(*) FILTER (WHERE dropped_reason = 'short') AS short, count(*) FILTER (WHERE dropped_reason = 'template') AS template, count(*) AS total FROM b WHERE dropped_reason IS NOT NULL GROUP BY lang")
def report_dropped_by_language(t):
    return report.dropped_by(_build(t, *B), "lang", ["short", "template"])


@query("report_dropped_by_source", f"WITH {_B} SELECT source, count(*) FILTER (WHERE dropped_reason = 'short') AS short, count(*) FILTER (WHERE dropped_reason = 'template') AS template, count(*) AS total FROM b WHERE dropped_reason IS NOT NULL GROUP BY source")
def report_dropped_by_source(t):
    return report.dropped_by(_build(t, *B), "source", ["short", "template"])


@query("report_removals", f"WITH {_A} SELECT 'template_sentence' AS reason, count(*) AS ranges, sum(e - s)::BIGINT AS characters, count(DISTINCT doc_id) AS works FROM a_r")
def report_removals(t):
    return report.removal_counts(_build(t, *A))


@query("report_top_templates", f"""
  WITH s AS ({SENTENCES}), m AS (SELECT doc_id, regexp_replace(sentence, '[0-9]+', '0', 'g') AS masked FROM s)
  SELECT masked, count(DISTINCT doc_id) AS works FROM m GROUP BY masked HAVING count(DISTINCT doc_id) >= 5 ORDER BY works DESC, masked LIMIT 30
""")
def report_top_templates(t):
    return report.top_templates(cleaning.template_sentences(cleaning.sentence_rows(t.documents, "doc_id"), "doc_id", 5))


@query("report_flags", f"WITH {_A} SELECT lang, count(*) FILTER (WHERE flag = 'other_language') AS other_language, count(*) FILTER (WHERE flag = 'truncated') AS truncated FROM a_f GROUP BY lang")
def report_flags(t):
    return report.flags_by(_build(t, *A), "lang", ["other_language", "truncated"])


@query("report_outcomes", f"WITH {_B} SELECT source, count(*) AS works, count(*) FILTER (WHERE dropped_reason IS NULL) AS kept, round(100 * count(*) FILTER (WHERE dropped_reason IS NULL) / count(*), 1) AS kept_percent FROM b GROUP BY source")
def report_outcomes(t):
    return report.outcome_rates(_build(t, *B), "source")


@query("report_examples", f"WITH {_B} SELECT source, count(*) AS works, count(*) FILTER (WHERE dropped_reason IS NULL) AS kept, arg_min(length(text), doc_id) FILTER (WHERE dropped_reason IS NULL) AS first_length, min(doc_id) FILTER (WHERE dropped_reason IS NULL) AS first_kept FROM b GROUP BY source")
def report_examples(t):
    return report.outcomes_with_example(_build(t, *B), "source", "text")


@query("report_duplicate_relations", """
  WITH d AS (SELECT *, CASE WHEN row_number() OVER w > 1 THEN first_value(doc_id) OVER w END AS original FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id))
  SELECT count(*) AS duplicates, count(*) FILTER (WHERE x.source = y.source) AS same_source, count(*) FILTER (WHERE x.lang = y.lang) AS same_language FROM d x JOIN d y ON x.original = y.doc_id
""")
def report_duplicate_relations(t):
    from pyspark.sql import Window

    order = Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")
    works = t.documents.select(F.col("doc_id").alias("work"), "source", "lang", F.when(F.row_number().over(order) > 1, F.first("doc_id").over(order)).alias("duplicate_of"))
    return report.duplicate_relations(works, {"same_source": F.col("a.source") == F.col("b.source"), "same_language": F.col("a.lang") == F.col("b.lang")})


@query("report_short", f"WITH {_A}, w AS (SELECT len({WORDS}) AS n FROM a WHERE dropped_reason IS NULL) SELECT count(*) AS kept, count(*) FILTER (WHERE n < 50) AS short, median(n) AS median_words, round(avg(n), 4) AS mean_words FROM w")
def report_short(t):
    return report.short_works(_build(t, *A), F.size(T.words(F.col("text"))), 50)


def _metrics_sql(b: str) -> str:
    return f"SELECT 'works' AS metric, count(*) AS n FROM {b} UNION ALL SELECT 'outcome.' || coalesce(dropped_reason, 'kept'), count(*) FROM {b} GROUP BY 1 UNION ALL SELECT 'flags.' || flag, count(*) FROM {b}_f GROUP BY 1 UNION ALL SELECT 'removals.template_sentence', count(*) FROM {b}_r"


@query("corpus_metrics", f"WITH {_A} SELECT metric, n AS value FROM ({_metrics_sql('a')})")
def corpus_metrics(t):
    return report.metrics(_build(t, *A))


@query("metrics_diff", f"WITH {_A}, {_B}, x AS ({_metrics_sql('a')}), y AS ({_metrics_sql('b')}) SELECT metric, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS now, coalesce(y.n, 0) - coalesce(x.n, 0) AS change FROM x FULL JOIN y USING (metric) WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)")
def metrics_diff(t):
    return report.compare_metrics(report.metrics(_build(t, *A)), report.metrics(_build(t, *B)))


@query("compare_transitions", f"WITH {_A}, {_B} SELECT coalesce(a.dropped_reason, 'kept') AS before, coalesce(b.dropped_reason, 'kept') AS now, count(*) AS works FROM a JOIN b USING (doc_id) WHERE a.dropped_reason IS DISTINCT FROM b.dropped_reason GROUP BY 1, 2")
def compare_transitions(t):
    return report.transitions(_build(t, *A), _build(t, *B))


@query("compare_removals", f"""
  WITH {_A}, {_B} SELECT 'template_sentence' AS reason, (SELECT count(*) FROM a_r) AS before, (SELECT count(*) FROM b_r) AS now,
    (SELECT count(*) FROM (FROM b_r EXCEPT FROM a_r)) AS new, (SELECT count(*) FROM (FROM a_r EXCEPT FROM b_r)) AS no_longer
""")
def compare_removals(t):
    return report.removal_changes(_build(t, *A), _build(t, *B))


@query("compare_outcomes", f"WITH {_A}, {_B} SELECT doc_id AS work, a.dropped_reason AS before, b.dropped_reason AS now FROM a JOIN b USING (doc_id) WHERE a.dropped_reason IS DISTINCT FROM b.dropped_reason")
def compare_outcomes(t):
    return report.changed_rows(_build(t, *A), _build(t, *B), ["work"], "dropped_reason")


@query("compare_sample", f"WITH {_A}, {_B}, c AS (SELECT doc_id AS work, b.dropped_reason AS now FROM a JOIN b USING (doc_id) WHERE a.dropped_reason IS DISTINCT FROM b.dropped_reason) SELECT work, now FROM c QUALIFY row_number() OVER (PARTITION BY now ORDER BY sha256(work::VARCHAR)) <= 15")
def compare_sample(t):
    changed = report.changed_rows(_build(t, *A), _build(t, *B), ["work"], "dropped_reason")
    return report.sample_per_group(changed, "now", "work").select("work", "now")
