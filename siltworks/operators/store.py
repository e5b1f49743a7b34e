"""The store: key sets, lookups, page updates and sinks over Parquet tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """``url`` of a text file, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def save_pending(urls: DataFrame, path: str) -> None:
    """Replace the saved frontier."""
    urls.select("url").write.mode("overwrite").parquet(path)


def append_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("append").parquet(path)


def reset_pages(spark: SparkSession, path: str) -> None:
    """Empty the table and keep its schema."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def save_postings(postings: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write postings in ranges of term, sorted, so that a term lookup reads few row groups."""
    ranged = postings.repartitionByRange(partitions, "term", "url") if partitions else postings.repartitionByRange("term", "url")
    ranged.sortWithinPartitions("term", "url").write.mode("overwrite").parquet(path)


def distinct_values(pages: DataFrame, column: str) -> DataFrame:
    return pages.select(column).where(F.col(column).isNotNull()).distinct()


def is_indexed(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def not_indexed(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of ``urls(url)`` that no indexed page has."""
    return urls.join(pages.where(is_indexed(F.col("is_indexed"))).select("url"), "url", "left_anti")


def update_pages(pages: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Pages with ``columns`` replaced where ``changes(url, ...)`` has the url; unknown urls are not created."""
    new = changes.select("url", *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    kept = [c for c in pages.columns if c not in columns]
    joined = pages.join(new, "url", "left")
    return joined.select(*kept, *[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns]).select(*pages.columns)


def document_frequency(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """``term, df`` of the asked terms, 0 where unknown."""
    return terms.select("term").distinct().join(stats.select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))


def lookup(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of a few terms by an equality filter that reaches the scan."""
    return postings.where(F.col("term").isin(terms))


def page_links(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.explode("links").alias("link"))


def check(spark: SparkSession, sf_dir: str, tables: list[str]) -> None:
    """Raise where a table of the store is missing."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").schema
