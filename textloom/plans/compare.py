"""Differences between runs, here made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare
from .registry import query


@query("multiset_difference", """
  SELECT l_partkey, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') GROUP BY l_partkey
""")
def multiset_difference(t):
    of = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).select("l_partkey")
    return compare.multiset_difference(of("R"), of("A"), ["l_partkey"])


@query("text_changes", """
  WITH c AS (SELECT doc_id, text AS a, replace(text, 'icense', 'icence') AS b FROM documents)
  SELECT doc_id, length(a) AS before_length, length(b) AS after_length, (strpos(a, 'icense') + 3)::INT AS at FROM c WHERE a IS DISTINCT FROM b
""")
def text_changes(t):
    after = t.documents.select("doc_id", F.replace("text", F.lit("icense"), F.lit("icence")).alias("text"))
    return compare.text_changes(t.documents, after, "doc_id", "text")


@query("decision_changes", """
  SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'new' WHEN p_size > 45 THEN 'gone' ELSE 'changed' END AS change FROM part WHERE p_size <= 5 OR p_size > 45 OR p_size BETWEEN 21 AND 25
""")
def decision_changes(t):
    """Two thresholds over the parts, each run knowing some parts only."""
    run = lambda low, high, least: t.part.where(F.col("p_size").between(low, high)).select("p_partkey", (F.col("p_size") > least).alias("split"), F.lit(None).cast("string").alias("reason"))
    return compare.decision_changes(run(6, 50, 20), run(1, 45, 25), ["p_partkey"], ["split", "reason"])


@query("present_in_all", """
  SELECT l_suppkey, l_linenumber, round(avg(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)
""")
def present_in_all(t):
    flags = t.lineitem.select("l_returnflag").distinct().count()
    return compare.present_in_all(t.lineitem, ["l_suppkey", "l_linenumber"], "l_returnflag", flags, {"quantity": F.round(F.avg("l_quantity"), 6)})
