"""Query history, suggestions and the pager."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def history(queries: DataFrame) -> DataFrame:
    """``query, n, first_seq`` of ``queries(query, seq)``: case-insensitive counts under the first spelling; blanks don't count."""
    said = queries.where(F.trim("query") != "").withColumn("query", F.trim("query"))
    return said.groupBy(F.lower("query").alias("k")).agg(F.min_by("query", "seq").alias("query"), F.count("*").alias("n"), F.min("seq").alias("first_seq")).drop("k")


def suggest(past: DataFrame, prefix: str, most: int = 5) -> DataFrame:
    """The ``most`` frequent queries that start with the prefix, whatever its case; ties by first use."""
    return past.where(F.startswith(F.lower("query"), F.lit(prefix.lower()))).orderBy(F.desc("n"), F.asc("first_seq")).limit(most)


def highlight(text: Column, typed: str) -> Column:
    """The first occurrence of the typed text in bold, whatever its case; unchanged without one."""
    at, n = F.instr(F.lower(text), typed.lower()), len(typed)
    marked = F.concat(F.substring(text, F.lit(1), at - 1), F.lit("<b>"), F.substring(text, at, F.lit(n)), F.lit("</b>"), F.substring(text, at + n, F.length(text)))
    return F.when((at > 0) & F.lit(n > 0), marked).otherwise(text)


def pager(current: Column, results: Column, size: int = 10, buttons: int = 3) -> Column:
    """Page numbers to show: at most ``buttons`` around the current page, moved inside 1..pages; empty without results."""
    pages = F.ceil(results / size).cast("int")
    first = F.greatest(F.lit(1), F.least(current - buttons // 2, pages - buttons + 1))
    return F.when(pages > 0, F.sequence(first.cast("int"), F.least(pages, first + buttons - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def page_count(results: int, size: int = 10) -> int:
    return math.ceil(results / size)


def is_blank(query: str) -> bool:
    return not query.strip()
