"""The index job: builds postings, statistics, ranks and word chunks of the pages, writes them, and serves queries from them.

Postings and statistics lie sorted by term, so a query's terms reach the scan as a filter that skips row groups.
Snippets are not stored - they would be sixty times the text - but cut from the stored words at the places that the
postings name, for the pages that a query hits only.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import graph, index, store
from siltworks.session import path_exists

PARTS = ("postings", "stats", "pages", "chunks", "failed")


@dataclass(frozen=True)
class StoredIndex:
    spark: SparkSession
    path: str

    def part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def hits(self, terms: list[str], snippets: bool = True) -> DataFrame:
        """Postings of the terms with their snippets; null where a term has no raw word on its page."""
        found = store.lookup(self.part("postings"), terms)
        if not snippets:
            return found.drop("spots")
        places = found.select("url", "term", F.explode("spots").alias("at"))
        return found.drop("spots").join(index.snippets_at(self.part("chunks"), places, "url"), ["url", "term"], "left")

    def stats(self, terms: list[str]) -> DataFrame:
        return store.lookup(self.part("stats"), terms)


def ranked_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages with ``page_rank`` of the graph of ``links(url, links)``; pages outside of it keep theirs."""
    nodes = store.distinct_values(links, "url").withColumnRenamed("url", "node")
    ranks = graph.pagerank(nodes, graph.link_graph(links)).select(F.col("node").alias("url"), F.col("rank").alias("page_rank"))
    return store.update_pages(pages, ranks, ["page_rank"])


def build_index(pages: DataFrame, path: str, mode: str = "compat", rank: bool = False) -> StoredIndex:
    """Write the index of ``pages(url, title, content, page_rank, h1, h2, h3)`` and give it back.

    With ``rank`` the pages' ``links`` are ranked first and the ranks are written with the pages. Pages without content
    can't be indexed and are listed in ``failed``. Parts are written whole, the mark of a finished index last.
    """
    spark = pages.sparkSession
    if rank:
        pages = ranked_pages(pages, pages)
    good = pages.where("content is not null")
    plain = index.build_postings(good, mode, with_snippets=False)
    spots = index.raw_words(good, "url", "content", mode).groupBy("url", "term").agg(F.sort_array(F.collect_list("at")).alias("spots"))
    store.save_postings(plain.join(spots, ["url", "term"], "left"), f"{path}/postings")
    stats = index.term_stats(spark.read.parquet(f"{path}/postings").select("term", "url"), pages)
    stats.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/stats")
    index.word_chunks(good, "url", "content").repartitionByRange("url", "chunk").sortWithinPartitions("url", "chunk").write.mode("overwrite").parquet(f"{path}/chunks")
    kept = [c for c in ("url", "title", "page_rank", "page_id", "content") if c in pages.columns]
    pages.select(*kept).write.mode("overwrite").parquet(f"{path}/pages")
    pages.where("content is null").select("url", F.lit("no content").alias("reason")).write.mode("overwrite").parquet(f"{path}/failed")
    spark.range(1).write.mode("overwrite").parquet(f"{path}/finished")
    return StoredIndex(spark, path)


def open_index(spark: SparkSession, path: str) -> StoredIndex | None:
    """The finished index at ``path``, or None."""
    return StoredIndex(spark, path) if path_exists(spark, f"{path}/finished/_SUCCESS") else None


def part_sizes(stored: StoredIndex) -> DataFrame:
    """``part, n`` rows of each part but the chunks."""
    counts = [stored.part(p).agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n") for p in PARTS if p != "chunks"]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
