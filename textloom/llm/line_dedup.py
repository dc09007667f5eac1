"""Line dedup: removal of lines that many sites share, keeping one document's copy.

A line is the text between line breaks, without surrounding spaces. Lines with fewer rows than ``min_sites`` cannot reach it
and leave after a count that combines before it shuffles. Of the others, each line hash gets HyperLogLog sketches of its sites,
built straight from its rows in salted parts and merged by aggregation. Lines whose estimate is clearly above or below
the threshold are decided by it; only for those near it are distinct pairs of line and site made and counted. Everything
runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_salted

MIN_SITES = 8
LG_K = 12
#: The standard error of a sketch with 2**12 registers is 1.6 %; estimates this near are counted exactly.
NEAR = 0.25


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _pair(line: Column) -> Column:
    """A 128-bit identity of a line."""
    cleaned = F.trim(line)
    return F.struct(F.xxhash64(cleaned).alias("a"), F.xxhash64(F.lit("second"), cleaned).alias("b"))


def boilerplate_lines(documents: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Lines on at least ``min_sites`` distinct sites: (a, b) of the line and the least doc_id that has it.

    Blank lines never count. A null site is no site.
    """
    lines = documents.select(
        F.col("doc_id").alias("_doc"),
        F.col(site).alias("_site"),
        F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _pair))).alias("_line"),
    ).select("_doc", "_site", "_line.a", "_line.b")
    often = lines.groupBy("a", "b").agg(F.count("_site").alias("_n"), F.min("_doc").alias("first_doc")).where(F.col("_n") >= min_sites).drop("_n")
    sited = lines.where("_site is not null").select("_site", "a", "b", F.xxhash64("_doc", "_site").alias("_spread"))
    rows = join_salted(sited, often.select("a", "b"), ["a", "b"], "_spread", "left_semi", salt="_part")
    sketches = rows.groupBy("a", "b", "_part").agg(F.hll_sketch_agg("_site", F.lit(LG_K)).alias("_sketch"))
    spread = sketches.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_union_agg("_sketch")).alias("_sites"))
    near = spread.where(F.col("_sites").between(min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1))
    pairs = join_salted(sited, near.select("a", "b"), ["a", "b"], "_spread", "left_semi", salt="_part").groupBy("a", "b", "_site").agg(F.count("*").alias("_rows"))
    exact = pairs.groupBy("a", "b").agg(F.count("*").alias("_exact"))
    return (
        spread.join(exact, ["a", "b"], "left")
        .where(F.coalesce("_exact", "_sites") >= min_sites)
        .select("a", "b")
        .join(often, ["a", "b"])
    )


def fresh(name: str, documents: DataFrame) -> str:
    """A column name that ``documents`` doesn't have."""
    while name.lower() in (c.lower() for c in documents.columns):
        name = "_" + name
    return name


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` but for those at the ascending positions ``gone`` (from 0): the slices between them, in one pass."""
    ends = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    between = F.transform(F.sequence(F.lit(1), F.size(gone) + 1), lambda k: F.slice(lines, F.get(ends, k - 1) + 2, F.get(ends, k) - F.get(ends, k - 1) - 1))
    return F.flatten(between)


def dedup_lines(documents: DataFrame, site: str = "source", min_sites: int = MIN_SITES, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``documents`` with their text without boilerplate, and two columns (named by parameters) with counts of lines.

    A line on at least ``min_sites`` sites stays in the document with the least doc_id that has it and goes
    from all others; the order of what stays is kept. Texts that lose nothing, nulls among them, are unchanged; an empty text is
    one empty line; the work on a very long text grows with its lines.
    Rows are never dropped: a document all of whose lines go keeps an empty text. Rows with a null
    doc_id keep their text. Repeated rows stay repeated, and an empty table gives an empty one. Other columns stay as they are; one that has the
    name of a count is an error, for ``fresh`` gives names that are free.
    """
    if clashing := sorted({c for c in documents.columns if c.lower() in (n_lines.lower(), n_removed.lower())}):
        raise ValueError(f"columns {clashing} are there already")
    bad = boilerplate_lines(documents, site, min_sites)
    doc, digest, hit = fresh("_doc", documents), fresh("_digest", documents), fresh("_hits", documents)
    rows = (
        documents.where("doc_id is not null")
        .select(F.col("doc_id").alias(doc), F.xxhash64("text").alias(digest), F.posexplode(_lines(F.col("text"))).alias("position", "line"))
        .where(F.trim("line") != "")
        .select(doc, digest, "position", _pair(F.col("line")).alias("line"))
        .select(doc, digest, "position", "line.a", "line.b", F.xxhash64(doc).alias("_spread"))
    )
    hits = join_salted(rows, bad, ["a", "b"], "_spread").where(F.col(doc) != F.col("first_doc")).groupBy(doc, digest).agg(F.sort_array(F.collect_set("position")).alias(hit))
    joined = documents.join(hits, (documents["doc_id"] == hits[doc]) & (F.xxhash64(documents["text"]) == hits[digest]), "left").drop(doc, digest)
    lines = _lines(F.col("text"))
    rebuilt = F.when(F.col(hit).isNull(), F.col("text")).otherwise(F.array_join(_without(lines, F.col(hit)), "\n"))
    removed = F.when(F.col(hit).isNull(), 0).otherwise(F.size(hit)).cast("long")
    return joined.withColumns({n_lines: F.size(lines).cast("long"), n_removed: removed, "text": rebuilt}).drop(hit)
