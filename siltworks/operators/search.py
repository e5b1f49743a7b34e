"""Term and phrase search with the weighted page score, as one plan per query."""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions.porter import with_stem
from siltworks.functions.text import contains_sentence, highlight_phrase, index_tokens, is_phrase, query_words, strip_bold, title_words
from siltworks.functions.urls import rank_key
from siltworks.operators.suggest import is_blank
from siltworks.schemas import RESULTS

# Weights of the score.
W_TFIDF, W_RANK, W_TITLE, HEADINGS, HEADING_CAP = 0.4, 0.3, 0.7, (0.45, 0.25, 0.10), 0.45


def query_terms(spark: SparkSession, query: str, mode: str = "compat") -> DataFrame:
    """``term``: distinct stems of the query; intended mode analyzes it as the index does."""
    one = spark.createDataFrame([(query,)], "q string")
    words = query_words(F.col("q")) if mode == "compat" else index_tokens(F.col("q"), mode)
    return with_stem(one.select(F.explode(words).alias("word")), "word", "term").select("term").distinct()


def matching_postings(postings: DataFrame, terms: DataFrame, every: bool = False) -> DataFrame:
    """Postings of any of the terms (``every``: of pages that have all of them). The terms are a query's, a bounded few."""
    hit = postings.join(F.broadcast(terms), "term")
    if not every:
        return hit
    full = hit.groupBy("url").agg(F.count_distinct("term").alias("n")).crossJoin(F.broadcast(terms.agg(F.count("*").alias("all")))).where("n = all")
    return hit.join(full.select("url"), "url", "left_semi")


def phrase_filter(postings: DataFrame, phrase: str, pages: DataFrame | None = None) -> DataFrame:
    """Postings with a snippet that holds the phrase between boundaries; with ``pages(url, content)`` those of pages whose text does."""
    if pages is not None:
        return postings.join(pages.where(contains_sentence(F.col("content"), phrase)).select("url"), "url", "left_semi")
    return postings.where(F.coalesce(F.exists("snippets", lambda s: contains_sentence(strip_bold(s), phrase)), F.lit(False)))


def score_components(hits: DataFrame, stats: DataFrame, pages: DataFrame, words: list[str]) -> DataFrame:
    """``link, tfidf, page_rank, title_matches, heading, title, snippets, term, id`` by rank key; ``id`` from pages with a ``page_id``.

    Title from the first and snippets from the last posting in order of term and url; an unknown page ranks 0.
    """
    ids = F.col("page_id") if "page_id" in pages.columns else F.lit(None).cast("string")
    rows = (
        hits.join(stats.select("term", "idf"), "term")
        .join(pages.select("url", "page_rank", ids.alias("__id")), "url", "left")
        .withColumn("page_rank", F.coalesce("page_rank", F.lit(0.0)))
        .withColumn("link", rank_key(F.col("url")))
    )
    flags = [F.when(F.element_at("headers", i + 1), w).otherwise(0.0) for i, w in enumerate(HEADINGS)]
    titled = sum((F.contains(F.lower("title"), F.lit(w)).cast("int") for w in words[1:]), F.contains(F.lower("title"), F.lit(words[0])).cast("int")) if words else F.lit(0)
    order = F.struct("term", "url")
    return rows.groupBy("link").agg(
        F.sum(F.col("tf") * F.col("idf")).alias("tfidf"),
        F.max("page_rank").alias("page_rank"),
        F.sum(F.coalesce(titled, F.lit(0))).alias("title_matches"),
        F.least(F.sum(flags[0] + flags[1] + flags[2]), F.lit(HEADING_CAP)).alias("heading"),
        F.min_by("title", order).alias("title"),
        F.max_by("snippets", order).alias("snippets"),
        F.max("term").alias("term"),
        F.min("__id").alias("id"),
    )


def _normalized(value: Column, top: Column, mode: str) -> Column:
    zero = F.lit(math.nan if mode == "compat" else 0.0)
    return F.when(top == 0, F.when(value == 0, zero).otherwise(F.when(value > 0, math.inf).otherwise(-math.inf))).otherwise(F.try_divide(value, top))


def final_scores(components: DataFrame, n_words: int, mode: str = "compat") -> DataFrame:
    """Add ``score``: components over their maxima, weighted. A zero maximum gives NaN in compat mode, else 0."""
    tops = components.agg(F.max("tfidf").alias("top_tfidf"), F.max("page_rank").alias("top_rank"))
    rows = components.crossJoin(F.broadcast(tops))
    score = (
        W_TFIDF * _normalized(F.col("tfidf"), F.col("top_tfidf"), mode)
        + W_RANK * _normalized(F.col("page_rank"), F.col("top_rank"), mode)
        + W_TITLE * F.col("title_matches") / max(n_words, 1)
        + F.col("heading")
    )
    return rows.withColumn("score", score).drop("top_tfidf", "top_rank")


def search(spark: SparkSession, query: str, postings: DataFrame, stats: DataFrame, pages: DataFrame, mode: str = "compat") -> DataFrame:
    """``term, url, title, snippet, id, score`` of a query, best first (NaN before all), ties by url.

    A query in double quotes is a phrase. Compat mode searches it in snippets and leaves ``term`` and ``id`` null;
    intended mode searches it in the text of ``pages`` where that has ``content``, and gives the last matched term and
    the page's ``page_id``. Blank queries have no results. Pages without a snippet of a matched term are dropped.
    """
    if is_blank(query):
        return spark.createDataFrame([], RESULTS)
    phrase = query[1:-1] if is_phrase(query) else None
    text = phrase if phrase is not None else query
    intended = mode == "intended"
    terms = query_terms(spark, text, mode)
    hits = matching_postings(postings, terms, every=phrase is not None and intended)
    if phrase is not None:
        hits = phrase_filter(hits, phrase, pages if intended and "content" in pages.columns else None)
    words = title_words(query, mode)
    scored = final_scores(score_components(hits, stats, pages, words), len(words), mode)
    if phrase is None:
        snippet = F.try_element_at("snippets", F.lit(1))
    else:
        found = F.filter("snippets", lambda s: contains_sentence(strip_bold(s), phrase))
        snippet = highlight_phrase(F.when(F.size(found) > 0, F.element_at(found, 1)), phrase, mode)
        snippet = F.coalesce(snippet, F.try_element_at("snippets", F.lit(1))) if intended else snippet
    nothing = F.lit(None).cast("string")
    rows = scored.where(F.size("snippets") > 0).select(
        (F.col("term") if intended else nothing).alias("term"), F.col("link").alias("url"), "title", snippet.alias("snippet"), (F.col("id") if intended else nothing).alias("id"), "score"
    )
    rows = rows.where("snippet is not null") if phrase is not None else rows
    return rows.orderBy(F.desc("score"), F.asc("url"))


def response(results: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
    """One row ``total, results``: how many results there are, and one page of them in order."""
    numbered = page_of(results, page, size)
    order = F.struct((-F.col("score")).alias("s"), F.col("url").alias("u"), F.struct(*results.columns).alias("r"))
    shown = numbered.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["r"]).alias("results"))
    return total(results).crossJoin(F.broadcast(shown))


def escaped(snippet: Column) -> Column:
    """A snippet that is safe to show: everything but the bold marks is escaped."""
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        snippet = F.replace(snippet, F.lit(c), F.lit(e))
    return F.replace(F.replace(snippet, F.lit("&lt;b&gt;"), F.lit("<b>")), F.lit("&lt;/b&gt;"), F.lit("</b>"))


def unranked(hits: DataFrame) -> DataFrame:
    """``term, url, title, snippet``: the first non-empty snippet of every posting that has one."""
    good = F.filter(F.coalesce("snippets", F.array().cast("array<string>")), lambda s: s != "")
    return hits.where(F.size(good) > 0).select("term", "url", "title", F.element_at(good, 1).alias("snippet"))


def total(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"))


def page_of(results: DataFrame, page: int, size: int = 10) -> DataFrame:
    """One page of ordered results."""
    return results.offset((page - 1) * size).limit(size)


def rank_numbered(results: DataFrame) -> DataFrame:
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("url"))))
