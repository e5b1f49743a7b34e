"""Clean view of the stored postings that all index operators share."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.urls import crawl_key, names_page
from siltworks.operators.skew import BROADCAST_BYTES


def index_term(term: Column) -> Column:
    """``lower(trim(term))``; null and blank terms are none."""
    t = F.lower(F.trim(term))
    return F.when(t != "", t)


def occurrences(postings: DataFrame) -> Column:
    """Stored frequency, or the number of positions where it is null."""
    return F.coalesce(postings["frequency"], F.size(postings["positions"]), F.lit(0)).cast("long")


def record_of(url: Column) -> list[Column]:
    """A page's 128-bit identifier in two columns, for counting pages without moving their addresses."""
    return [F.xxhash64(url).alias("record"), F.xxhash64(F.lit(7), url).alias("record_2")]


def with_pages(postings: DataFrame, how: str = "inner") -> DataFrame:
    """Add ``page``, the crawl key, and its ``record, record_2``; rows that name no page go (``how`` 'left': get nulls).

    An address stands in as many rows as its page has terms. Where the distinct addresses, estimated first, fit into
    BROADCAST_BYTES, their keys are computed once each and broadcast; else every row's key is computed in place.
    """
    rows = postings.select(*[c for c in postings.columns if c not in ("page", "record", "record_2")])
    keyed = lambda df: df.withColumn("page", crawl_key(F.col("url"))).select("*", *record_of(F.col("page")))
    distinct, width = rows.agg(F.approx_count_distinct("url"), F.avg(F.length("url"))).first()
    if distinct * (2 * (width or 0) + 96) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keyed(rows.where(names_page(F.col("url"))).select("url").distinct())), "url", how)
    if how == "inner":
        return keyed(rows.where(names_page(F.col("url"))))
    page = F.when(names_page(F.col("url")), crawl_key(F.col("url")))
    record = [F.when(F.col("page").isNotNull(), c).alias(n) for c, n in zip(record_of(F.col("page")), ("record", "record_2"), strict=True)]
    return rows.withColumn("page", page).select("*", *record)


def indexed(postings: DataFrame) -> DataFrame:
    """``term, url, record, record_2, occurrences, at`` of each posting row that has an index term and names a page.

    ``url`` is the crawl key, ``at`` the microseconds of ``indexed_at`` (null counts as earliest). Other columns are
    dropped, so extra columns with clashing names do no harm.
    """
    own = postings.select("term", "url", "frequency", "positions", "indexed_at").where(F.trim("term") != "")
    rows = with_pages(own)
    return rows.select(
        F.lower(F.trim("term")).alias("term"),
        F.col("page").alias("url"),
        "record",
        "record_2",
        occurrences(rows).alias("occurrences"),
        F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(0)).alias("at"),
    )


def latest(rows: DataFrame) -> DataFrame:
    """``url, term, occurrences``: one row per page and term of indexed rows, of the latest row (ties: the most occurrences).

    Time and count travel in one decimal, so the aggregation stays a hash aggregation with map-side combine.
    """
    base = F.lit(2**31).cast("decimal(10,0)")
    packed = F.col("at").cast("decimal(20,0)") * base + F.col("occurrences").cast("decimal(10,0)")
    best = rows.groupBy("url", "term").agg(F.max(packed).alias("packed"))
    return best.select("url", "term", F.pmod(F.col("packed"), base).cast("long").alias("occurrences"))
