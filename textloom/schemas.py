"""Declared schemas of the corpus tables."""

from __future__ import annotations

SENTENCE = "struct<start:bigint,end:bigint,language:string,confidence:double>"
REMOVAL = "struct<start:bigint,end:bigint,reason:string>"

ABSTRACTS = (
    f"work_id string, year bigint, decade bigint, fields array<string>, source string, document_type string, author_ids array<string>, "
    f"text string, sentences array<{SENTENCE}>, removals array<{REMOVAL}>, flags array<string>, dropped_reason string, duplicate_of string"
)
RAW_WORK = "id string, year int, type string, authors array<string>, abstract string"
METADATA = (
    "id string, missing boolean, fetched string, doi string, ids struct<pmid:string,pmcid:string>, title string, type string, publication_date string, language string, "
    "primary_location struct<source:struct<display_name:string,type:string,issn_l:string,issn:array<string>>>, indexed_in array<string>, is_paratext boolean, is_retracted boolean"
)
CROSSREF = (
    "work_id string, identifier string, fetched string, missing boolean, invalid_doi boolean, type string, title array<string>, `container-title` array<string>, ISSN array<string>, "
    "published struct<`date-parts`:array<array<bigint>>>, abstract string, page string, `references-count` bigint, relation string, `update-to` array<struct<type:string>>, "
    "`updated-by` array<struct<type:string>>, license array<struct<URL:string,`content-version`:string>>, link array<struct<URL:string,`intended-application`:string>>"
)
PUBMED = (
    "work_id string, identifier string, fetched string, missing boolean, is_book boolean, status string, title string, abstract array<struct<label:string,text:string>>, "
    "publication_types array<string>, mesh_headings array<struct<descriptor:string,is_major:boolean>>, keywords array<string>, languages array<string>, pages string, journal string, "
    "journal_nlm_id string, comments_corrections array<struct<type:string>>"
)
