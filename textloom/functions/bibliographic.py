"""Column functions on bibliographic fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PAGES = 2000
_RANGE = r"^ *([0-9]+) *[-–] *([0-9]+) *$"


def page_count(pages: Column) -> Column:
    """Pages of one range; a shortened end takes the start's first digits ("1649-53" is 5); else null, over 2,000 too."""
    start, end = F.regexp_extract(pages, _RANGE, 1), F.regexp_extract(pages, _RANGE, 2)
    head = F.substr(start, F.lit(1), F.greatest(F.length(start) - F.length(end), F.lit(0)))
    n = F.concat(head, end).try_cast("bigint") - start.try_cast("bigint") + 1
    return F.when(n.between(1, MAX_PAGES), n)


def is_valid_issn(issn: Column) -> Column:
    """The form ####-###X and the check digit of ISO 3297."""
    digits = F.replace(issn, F.lit("-"), F.lit(""))
    total = reduce(lambda a, b: a + b, [F.substring(digits, k + 1, 1).try_cast("int") * (8 - k) for k in range(7)])
    check = (11 - total % 11) % 11
    wanted = F.when(check == 10, F.lit("X")).otherwise(check.cast("string"))
    return F.coalesce(issn.rlike("^[0-9]{4}-[0-9]{3}[0-9X]$") & (F.substring(digits, 8, 1) == wanted), F.lit(False))


def bare_doi(doi: Column) -> Column:
    return F.lower(F.regexp_replace(doi, r"^https?://(dx\.)?doi\.org/", ""))


def last_segment(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def valid_issns(issns: Column) -> Column:
    return F.filter(F.coalesce(issns, F.array().cast("array<string>")), is_valid_issn)


def is_repository_only(source_type: Column, indexed_in: Column) -> Column:
    """A repository's work that no scholarly index lists."""
    indexed = F.arrays_overlap(F.coalesce(indexed_in, F.array().cast("array<string>")), F.array(*map(F.lit, ("crossref", "doaj", "pubmed"))))
    return F.coalesce(source_type == "repository", F.lit(False)) & ~F.coalesce(indexed, F.lit(False))


def corrected(df, corrections, key: str = "id", field: str = "doi"):
    """Override a field from a small table (key, field); a correction may set null."""
    fixed = corrections.select(F.col(key), F.col(field).alias("_fixed"), F.lit(True).alias("_is_fixed"))
    return df.join(fixed, key, "left").withColumn(field, F.when(F.col("_is_fixed"), F.col("_fixed")).otherwise(F.col(field))).drop("_fixed", "_is_fixed")


def _texts(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _kinds(column: str) -> Column:
    """The distinct types of a list of structs, sorted."""
    return _texts(F.array_sort(F.array_distinct(F.transform(column, lambda x: x["type"]))))


def _not_empty(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def openalex_works(metadata, corrections):
    """Flat works from nested metadata records, DOIs corrected, ISSNs that fail their check digit left out."""
    source = "primary_location.source"
    issn_l = F.col(f"{source}.issn_l")
    return corrected(metadata, corrections).select(
        F.col("id").alias("work_id"),
        F.coalesce("missing", F.lit(False)).alias("is_missing"),
        _not_empty(bare_doi(F.col("doi"))).alias("doi"),
        last_segment(F.col("ids.pmid")).alias("pmid"),
        F.concat(F.lit("PMC"), F.regexp_replace(last_segment(F.col("ids.pmcid")), "^PMC", "")).alias("pmcid"),
        "title",
        F.col("type").alias("openalex_type"),
        F.year(F.col("publication_date").try_cast("date")).cast("bigint").alias("publication_year"),
        "language",
        F.col(f"{source}.display_name").alias("source_name"),
        F.col(f"{source}.type").alias("source_type"),
        F.when(is_valid_issn(issn_l), issn_l).alias("issn_l"),
        valid_issns(F.col(f"{source}.issn")).alias("issns"),
        _texts(F.col("indexed_in")).alias("indexed_in"),
        F.coalesce("is_paratext", F.lit(False)).alias("is_paratext"),
        F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"),
    )


def crossref_works(records, jats_text):
    """Flat rows of nested registry records; ``jats_text`` turns a column of mark-up into its text."""
    return records.select(
        "work_id",
        F.lower("identifier").alias("doi"),
        (~F.coalesce("missing", F.lit(False))).alias("is_found"),
        F.coalesce("invalid_doi", F.lit(False)).alias("is_invalid_doi"),
        F.col("type").alias("crossref_type"),
        F.get("title", F.lit(0)).alias("title"),
        F.get("`container-title`", F.lit(0)).alias("container_title"),
        valid_issns(F.col("ISSN")).alias("issns"),
        F.get(F.get("published.date-parts", F.lit(0)), F.lit(0)).alias("published_year"),
        jats_text(F.col("abstract")).alias("abstract"),
        "page",
        page_count(F.col("page")).alias("page_count"),
        F.col("references-count").alias("references_count"),
        _texts(F.array_sort(F.json_object_keys("relation"))).alias("relation_types"),
        _kinds("update-to").alias("update_types"),
        F.col("updated-by").isNotNull().alias("is_updated"),
        _texts(F.transform("license", lambda x: x["URL"])).alias("licence_urls"),
        F.coalesce(F.exists("license", lambda x: x["content-version"] == "tdm"), F.lit(False)).alias("has_text_mining_licence"),
        _texts(F.transform(F.filter("link", lambda x: x["intended-application"] == "text-mining"), lambda x: x["URL"])).alias("text_mining_links"),
        F.to_date("fetched").alias("fetched"),
    )


def pubmed_works(records):
    """Flat rows of nested article records; a structured abstract becomes "LABEL: text" parts, empty text is null."""
    part = lambda a: F.concat(F.coalesce(F.concat(_not_empty(a["label"]), F.lit(": ")), F.lit("")), a["text"])
    return records.select(
        "work_id",
        F.col("identifier").alias("pmid"),
        (~F.coalesce("missing", F.lit(False))).alias("is_found"),
        F.coalesce("is_book", F.lit(False)).alias("is_book"),
        _not_empty(F.col("status")).alias("status"),
        _not_empty(F.col("title")).alias("title"),
        _texts(F.col("publication_types")).alias("publication_types"),
        _texts(F.transform("mesh_headings", lambda m: m["descriptor"])).alias("mesh_descriptors"),
        _texts(F.transform(F.filter("mesh_headings", lambda m: m["is_major"]), lambda m: m["descriptor"])).alias("mesh_major_descriptors"),
        _texts(F.col("keywords")).alias("keywords"),
        _texts(F.col("languages")).alias("languages"),
        _not_empty(F.array_join(F.transform("abstract", part), " ")).alias("abstract"),
        F.coalesce(F.exists("abstract", lambda a: a["label"] != ""), F.lit(False)).alias("is_structured_abstract"),
        _not_empty(F.col("pages")).alias("page"),
        page_count(F.col("pages")).alias("page_count"),
        _not_empty(F.col("journal")).alias("journal"),
        _not_empty(F.col("journal_nlm_id")).alias("journal_nlm_id"),
        _kinds("comments_corrections").alias("comment_types"),
        F.to_date("fetched").alias("fetched"),
    )
