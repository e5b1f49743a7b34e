"""Breadth-first crawl over a table of fetched pages, with robots rules and content deduplication."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.text import fingerprint
from siltworks.functions.urls import crawl_key, robots_base
from siltworks.session import ensure_checkpoint_dir

# Pages that a crawl stores at most, and the names that robots rules call us by.
LIMIT = 6000
AGENTS = ("*", "MyCrawler/1.0")


def start_urls(pending: DataFrame, seeds: DataFrame) -> DataFrame:
    """``url``: pending urls, or the seeds where there are none."""
    return pending.select("url") if pending.take(1) else seeds.select("url")


def unseen(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """``url, norm, seq``: one row per crawl key, the earliest, that is no key of ``visited(norm)``."""
    keyed = frontier.select("url", "seq", crawl_key(F.col("url")).alias("norm"))
    first = keyed.groupBy("norm").agg(F.min(F.struct("seq", "url")).alias("f")).select("f.url", "norm", "f.seq")
    return first.join(visited.select("norm"), "norm", "left_anti").select("url", "norm", "seq")


def robots_rules(files: DataFrame, mode: str = "compat") -> DataFrame:
    """``base, disallow`` of ``files(base, text)``.

    A ``User-agent:`` line switches rules on for our names and off for others; then ``Disallow:`` lines with a value
    add prefixes. Compat mode collapses line ends first, as the text arrives, so no rule survives; intended mode reads lines.
    """
    text = F.col("text") if mode == "intended" else F.regexp_replace(F.trim("text"), r"\s+", " ")
    lines = files.select("base", F.posexplode(F.split(text, "\n")).alias("at", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "\r$", "")))
    named = F.trim(F.regexp_extract("line", r"^User-agent:(.*)$", 1)).isin(*AGENTS)
    ours = F.last(F.when(F.startswith("line", F.lit("User-agent:")), named), ignorenulls=True).over(Window.partitionBy("base").orderBy("at"))
    rule = F.regexp_extract("line", r"^Disallow:\s*(.+)$", 1)
    return lines.withColumn("ours", ours).where(F.coalesce("ours", F.lit(False)) & (rule != "")).select("base", F.trim(rule).alias("disallow")).distinct()


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``urls(url, ...)`` whose rest behind the base starts with none of the base's prefixes; others pass.

    An equi-join on the base with the prefix test as a residual, so only a host's own rules are compared.
    """
    keyed = urls.withColumn("base", robots_base(F.col("url")))
    r = rules.select(F.col("base").alias("rule_base"), "disallow")
    rest = F.expr("substring(url, length(base) + 1)")
    blocked = (F.col("base") == F.col("rule_base")) & F.startswith("url", F.col("base")) & F.startswith(rest, F.col("disallow"))
    return keyed.join(r, blocked, "left_anti").drop("base")


def first_contents(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``pages(fingerprint, seq, url, ...)`` that are the first of their fingerprint and not in ``known(fingerprint)``.

    The first rows are found by an aggregation that combines before the shuffle, so a content with a third of all
    pages costs a row a task; contents themselves are joined with the winners only. Null fingerprints are unique.
    """
    first = pages.where("fingerprint is not null").groupBy("fingerprint").agg(F.min(F.struct("seq", "url")).alias("f")).join(known.select("fingerprint"), "fingerprint", "left_anti")
    winners = first.select(F.col("f.seq").alias("__seq"), F.col("f.url").alias("__url"))
    return pages.join(winners, (F.col("seq") == F.col("__seq")) & (F.col("url") == F.col("__url")), "left_semi").unionByName(pages.where("fingerprint is null"))


@dataclass(frozen=True)
class Crawl:
    """``stored``: ``url, norm, title, content, fingerprint, depth``; ``frontier``: ``url`` of what is left; ``seen``: ``norm`` of all keys met."""

    stored: DataFrame
    frontier: DataFrame
    seen: DataFrame


def _cut(pages: DataFrame, left: int) -> DataFrame:
    """The first ``left`` rows by ``seq`` and ``norm``: the bound is found on these two columns, the pages are filtered by it."""
    last = pages.select("seq", "norm").orderBy("seq", "norm").limit(left).agg(F.max(F.struct("seq", "norm")).alias("m")).first()["m"]
    return pages.where((F.col("seq") < F.lit(last["seq"])) | (F.col("seq") == F.lit(last["seq"])) & (F.col("norm") <= F.lit(last["norm"])))


def crawl(start: DataFrame, web: DataFrame, rules: DataFrame, visited: DataFrame, known: DataFrame, limit: int = LIMIT, dedup_content: bool = True) -> Crawl:
    """A crawl from ``start(url)`` until ``limit`` pages are stored or the frontier is empty.

    ``web(norm, title, content, links)`` has the pages that can be fetched, ``visited(norm)`` and ``known(fingerprint)``
    what is stored already. Every round is one plan: drop seen keys, apply robots rules, fetch by join, drop known
    contents, expand links. Within a round addresses come in code point order. Keys count as seen before they are
    fetched, so failures are not tried again. Links of duplicates are not followed. Only a round that goes beyond the
    limit is sorted, on its keys; its other pages and the links found last stay in the frontier, to be saved and
    resumed. Seen keys are appended per round and rewritten when the rounds since the last time have doubled.
    """
    spark = start.sparkSession
    ensure_checkpoint_dir(spark)
    frontier = start.where("url is not null").select("url", F.col("url").alias("seq"))
    seen, prints, n, depth, rewritten = visited.select("norm"), known.select("fingerprint"), 0, 0, 8
    stored = web.limit(0).select(F.col("norm").alias("url"), "norm", "title", "content", F.lit("").alias("fingerprint"), F.lit(0).alias("depth"))
    left = spark.createDataFrame([], "url string")
    while True:
        new = unseen(frontier, seen).checkpoint()
        if n >= limit or not new.take(1):
            left = left.unionByName(new.select("url"))
            break
        got = allowed(new, rules).join(web, "norm").withColumn("fingerprint", fingerprint(F.col("title"), F.col("content")))
        got = (first_contents(got, prints) if dedup_content else got).withColumn("depth", F.lit(depth)).checkpoint()
        found = got.count()
        if found > limit - n:
            whole, got = got, _cut(got, limit - n)
            left = left.unionByName(whole.join(got.select("norm"), "norm", "left_anti").select("url"))
        out = got.select("url", "norm", "title", "content", "fingerprint", "depth")
        stored = stored.unionByName(out)
        n += min(found, limit - n)
        seen = seen.unionByName(new.select("norm"))
        prints = prints.unionByName(got.select("fingerprint"))
        depth += 1
        if depth == rewritten:
            seen, prints, stored, rewritten = seen.checkpoint(), prints.checkpoint(), stored.checkpoint(), 2 * rewritten
        links = got.select(F.explode("links").alias("url")).where("url is not null and url <> ''")
        frontier = links.select("url", F.col("url").alias("seq"))
    return Crawl(stored, left, seen)


def crawl_stats(stored: DataFrame) -> DataFrame:
    """``pages, distinct_pages, characters``."""
    return stored.agg(F.count("*").alias("pages"), F.count_distinct("norm").alias("distinct_pages"), F.sum(F.length("content")).alias("characters"))
