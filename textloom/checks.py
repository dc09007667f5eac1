"""Row and reference checks that raise with a count of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What every abstract must satisfy; each expression is true for a good row.
ABSTRACT_RULES = {
    "work_id": "work_id rlike '^https://openalex[.]org/W[0-9]+$'",
    "year": "year between 1900 and 2100",
    "decade": "decade = year - year % 10",
    "fields": "size(fields) > 0",
    "source": "source rlike '^(regular|download:[a-z0-9_-]+)$'",
    "removals": "forall(removals, r -> r.start >= 0 and r.start < r.end and r.end <= length(text))",
    "sentences": "forall(sentences, s -> s.start >= 0 and s.start < s.end and s.end <= length(text))",
}


def violations(df: DataFrame, rules: dict[str, str], unique: str | None = None) -> dict[str, int]:
    """How many rows break each rule; a null counts as broken. One pass, besides the one for ``unique``."""
    counts = [F.coalesce(F.sum((~F.coalesce(F.expr(rule), F.lit(False))).cast("long")), F.lit(0)).alias(name) for name, rule in rules.items()]
    found = {k: v for k, v in df.agg(*counts).first().asDict().items() if v} if rules else {}
    if unique:
        repeated = df.groupBy(unique).count().where("count > 1").count()
        found |= {f"unique {unique}": repeated} if repeated else {}
    return found


def check(df: DataFrame, rules: dict[str, str], unique: str | None = None) -> DataFrame:
    if found := violations(df, rules, unique):
        raise ValueError(f"rows break the rules: {found}")
    return df


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner: the referential check."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def check_reference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    if n := unmatched(left, right, on).count():
        raise ValueError(f"{n} rows have no partner on {on}")
    return left


def null_as_false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))
