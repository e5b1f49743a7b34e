"""References to records that do not exist, no longer exist, or arrive after the reference was made.

Distinct keys fall into small hash buckets (neighbouring object ids into one) and become dense integers by their order
there, parents and referenced keys alike. Sorted parent integers make contiguous runs; every referenced key is matched
as of the run that starts at or before it. A key beyond that run's end has no parent and is an orphan at once; a key
inside the run meets its parent there, whose times decide removal and late arrival. One sorted pass does all of it, on
distinct keys with pre-aggregated times; the references themselves are read a second time and joined with the suspect
keys only, broadcast after a check of their size, else with heavy keys spread over tasks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.urls import page_key
from siltworks.operators.postings import index_term
from siltworks.operators.skew import sized_join
from siltworks.session import ensure_checkpoint_dir

HASH_SHIFT = 44
PREFIX = 20


def key_bucket(key: Column) -> Column:
    """Bucket of a key: object ids that differ in their last four digits only share one."""
    return F.shiftright(F.xxhash64(F.when(key.rlike("^[0-9a-f]{24}$"), F.substring(key, 1, PREFIX)).otherwise(key)), HASH_SHIFT)


def match_runs(asked: DataFrame, parents: DataFrame) -> DataFrame:
    """``key, first_ref, beyond, first_stored, gone`` of every row of ``asked(key, first_ref)``.

    ``parents(key, first_stored, gone)`` and ``asked`` have each key once. ``beyond`` tells that the key lies beyond the
    run of parents before it; the other columns are those of the last parent of that run up to the key.
    """
    both = parents.select("key", F.lit(0).alias("kind"), F.lit(None).cast("timestamp").alias("first_ref"), F.struct("first_stored", "gone").alias("parent")).unionByName(
        asked.select("key", F.lit(1).alias("kind"), "first_ref"), allowMissingColumns=True
    )
    w = Window.partitionBy("bucket").orderBy("key", "kind")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    previous = F.lag("key").over(w)
    numbered = both.withColumn("bucket", key_bucket(F.col("key"))).withColumn("step", F.when(previous == F.col("key"), 0).otherwise(1)).withColumn("id", F.sum("step").over(so_far))
    run_end = F.last(F.when(F.col("kind") == 0, F.col("id")), ignorenulls=True).over(so_far)
    latest = F.last("parent", ignorenulls=True).over(so_far)
    seen = numbered.withColumn("run_end", run_end).withColumn("latest", latest).where("kind = 1")
    return seen.select("key", "first_ref", F.coalesce(F.col("id") > F.col("run_end"), F.lit(True)).alias("beyond"), "latest.first_stored", "latest.gone")


def suspect_keys(refs: DataFrame, parents: DataFrame, removals: DataFrame) -> DataFrame:
    """``key, first_stored``: keys with an orphan reference.

    ``refs(key, at)``, ``parents(key, stored_at)``, ``removals(key, removed_at)``. ``first_stored`` is null where every
    reference to the key is an orphan (never held, or removed after the newest row), else references earlier than it
    are. Null keys are no references; a reference without time is an orphan only in the first way; a parent row
    without ``stored_at`` counts as always held; a removal without time is ignored. Empty tables give no rows, or all
    references where there are no parents.
    """
    asked = refs.where("key is not null").groupBy("key").agg(F.min("at").alias("first_ref"))
    held = (
        parents.where("key is not null")
        .groupBy("key")
        .agg(
            F.min(F.coalesce("stored_at", F.lit("0001-01-01").cast("timestamp"))).alias("first_stored"),
            F.max("stored_at").alias("last_stored"),
        )
        .join(removals.where("key is not null").groupBy("key").agg(F.max("removed_at").alias("removed")), "key", "left")
        .select("key", "first_stored", F.coalesce(F.col("removed") > F.col("last_stored"), F.lit(False)).alias("gone"))
    )
    placed = match_runs(asked, held)
    never = F.col("beyond") | F.col("gone")
    return placed.where(never | (F.col("first_ref") < F.col("first_stored"))).select("key", F.when(~never, F.col("first_stored")).alias("first_stored"))


def orphan_references(refs: DataFrame, parents: DataFrame, removals: DataFrame) -> DataFrame:
    """The rows of ``refs(key, at, ...)`` that are orphans; see suspect_keys for the cases. Repeated rows are kept."""
    ensure_checkpoint_dir(refs.sparkSession)
    suspects = suspect_keys(refs, parents, removals).withColumnRenamed("first_stored", "__first").checkpoint()
    record = F.xxhash64(*refs.columns)
    hit = sized_join(refs.where("key is not null"), suspects, "key", record, F.length("key") + 16)
    return hit.where(F.col("__first").isNull() | (F.col("at") < F.col("__first"))).select(*refs.columns)


def _ts(c: Column) -> Column:
    return c.cast("timestamp")


def crawl_references(pages: DataFrame, postings: DataFrame, removed: DataFrame) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """The two kinds of references of the store as ``(refs, parents, removals)``: links between pages, ids in postings."""
    own = lambda c: F.lower(F.trim(c))
    links = (
        pages.select(own(pages["page_id"]).alias("from_key"), _ts(pages["last_indexed"]).alias("at"), F.explode("links").alias("link"))
        .select(F.lit("visited_pages").alias("table_name"), "from_key", "at", page_key(F.col("link")).alias("key"))
        .where("key is not null")
    )
    ids = postings.select(
        F.lit("postings").alias("table_name"),
        index_term(postings["term"]).alias("from_key"),
        _ts(postings["indexed_at"]).alias("at"),
        own(postings["page_id"]).alias("key"),
    ).where("from_key is not null and key is not null")
    return [
        (links, pages.select(page_key(pages["url"]).alias("key"), _ts(pages["stored_at"]).alias("stored_at")), removed.select(page_key(removed["url"]).alias("key"), _ts(removed["removed_at"]).alias("removed_at"))),
        (ids, pages.select(own(pages["page_id"]).alias("key"), _ts(pages["stored_at"]).alias("stored_at")), removed.select(own(removed["page_id"]).alias("key"), _ts(removed["removed_at"]).alias("removed_at"))),
    ]


def orphans(pages: DataFrame, postings: DataFrame, removed: DataFrame) -> DataFrame:
    """``table_name, from_key, ref_key, at`` of every orphan reference of the store, repeated references included."""
    a, b = (orphan_references(*x).select("table_name", "from_key", F.col("key").alias("ref_key"), "at") for x in crawl_references(pages, postings, removed))
    return a.unionByName(b)


def orphan_report(pages: DataFrame, postings: DataFrame, removed: DataFrame) -> DataFrame:
    """``table_name, month, orphans``: distinct orphan references by table and month (null: no time) of the reference."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    found = orphans(pages, postings, removed).select("table_name", month, "from_key", "ref_key").distinct()
    return found.groupBy("table_name", "month").agg(F.count("*").alias("orphans"))
