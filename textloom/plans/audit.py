"""What the cells hold, sources and decades made of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from .registry import query

_TARGETS = ["the", "der", "license"]
_LINES = """
  d AS (SELECT source, (floor(month(DATE '1970-01-01' + n_chars::INT) / 2) * 10 + 1900)::BIGINT AS decade, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents),
  s AS (SELECT min(source) AS left_out FROM documents)
"""


def _lines(t):
    """The driver's documents carry no year; one is made from the length of the text."""
    decade = F.floor(F.month(F.date_add(F.lit("1970-01-01").cast("date"), F.col("n_chars").cast("int"))) / 2) * 10 + 1900
    return t.documents.select("source", decade.alias("decade"), F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("w"))


@query("audit_cells", f"WITH {_LINES} SELECT source, decade, count(*) AS documents, sum(len(w))::BIGINT AS tokens FROM d GROUP BY 1, 2")
def audit_cells(t):
    return audit.count_cells(_lines(t), ["source", "decade"], "w")


@query("audit_targets", f"""
  WITH {_LINES}, c AS (SELECT DISTINCT source, decade FROM d), x AS (SELECT source, decade, unnest(w) AS target FROM d), f AS (SELECT source, decade, target, count(*) AS n FROM x WHERE target IN ('the', 'der', 'license') GROUP BY 1, 2, 3),
  e AS (SELECT c.source, c.decade, t.target, coalesce(f.n, 0) AS n FROM c CROSS JOIN (SELECT unnest(['the', 'der', 'license']) AS target) t LEFT JOIN f ON f.source = c.source AND f.decade = c.decade AND f.target = t.target),
  m AS (SELECT target, decade, sum(n) AS n FROM e, s WHERE source <> left_out GROUP BY 1, 2), l AS (SELECT *, lag(n) OVER (PARTITION BY target ORDER BY decade) AS before FROM m)
  SELECT target, sum(n)::BIGINT AS n, count(*) FILTER (WHERE n > 0) AS decades, count(*) FILTER (WHERE before >= 20 AND n >= 20) AS transitions FROM l GROUP BY target
""")
def audit_targets(t):
    """The first source by name is the layer that is left out."""
    first = t.documents.agg(F.min("source")).first()[0]
    return audit.audit_targets(_lines(t), "source", "decade", "w", _TARGETS, first, 20)
