"""Per-key work without hot tasks: fragment and replicate by estimated load.

The load of every key is its number of rows (combined before the shuffle). Keys above ``share`` of all rows - at most
1/share of them, whatever the data - are split into shards in proportion to their load; the other keys fall into a
fixed number of hash groups. Shards and groups are packed onto tasks, largest first. The driver sees 1/share + groups
rows at most. A row of a split key goes to the shard of its record's hash, so that records stay whole and counts of
distinct records add up over shards; a matching side is replicated to the shards of split keys only.
"""

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARE = 0.008
GROUPS = 1024
#: A side of a join is broadcast up to this measured size.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Plan:
    """``shards``: split key -> number of shards; ``slots``: shard or group -> slot, one slot value per task."""

    tasks: int
    groups: int
    shards: dict[str, int]
    slots: dict[tuple[str, int], int]
    load: list[int]


def key_loads(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("load"))


def slot_values(spark: SparkSession, tasks: int) -> list[int]:
    """One integer per task such that hash partitioning puts each into a partition of its own."""
    taken: dict[int, int] = {}
    start = 0
    while len(taken) < tasks:
        found = spark.range(start, start + 64 * tasks, 1, 1).select(F.col("id").cast("int").alias("v"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("p"))
        for v, p in found.collect():
            taken.setdefault(p, v)
        start += 64 * tasks
    return [taken[p] for p in range(tasks)]


def bin_pack(loads: list[tuple[tuple[str, int], int]], tasks: int) -> tuple[dict[tuple[str, int], int], list[int]]:
    """Largest load first onto the least loaded task: ``unit -> task`` and the load of each task."""
    heap = [(0, t) for t in range(tasks)]
    to, total = {}, [0] * tasks
    for unit, load in sorted(loads, key=lambda x: (-x[1], x[0])):
        _, t = heapq.heappop(heap)
        to[unit] = t
        total[t] += load
        heapq.heappush(heap, (total[t], t))
    return to, total


def plan_tasks(spark: SparkSession, loads: DataFrame, tasks: int, share: float = SHARE, groups: int = GROUPS) -> Plan:
    """Fit a plan to ``loads(key, load)``; empty loads give a plan without split keys."""
    loads = loads.persist()
    total = loads.agg(F.sum("load")).first()[0] or 0
    heavy = F.col("load") > share * total
    split = {k: n for k, n in loads.where(heavy).collect()}
    light = loads.where(~heavy).groupBy(F.pmod(F.hash("key"), F.lit(groups)).alias("g")).agg(F.sum("load").alias("load")).collect()
    loads.unpersist()
    fair = max(1.0, total / (tasks * 4))
    shards = {k: max(1, -(-n // int(fair))) for k, n in split.items()}
    units = [((k, s), -(-split[k] // c)) for k, c in shards.items() for s in range(c)] + [(("", g), n) for g, n in light]
    to, load = bin_pack(units, tasks)
    values = slot_values(spark, tasks)
    return Plan(tasks, groups, shards, {u: values[t] for u, t in to.items()}, load)


def _lookup(mapping: dict, key: Column, value_type: str) -> Column:
    """A literal map; its size is bounded by 1/share and groups."""
    if not mapping:
        return F.lit(None).cast(value_type)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key).cast(value_type)


def with_slot(rows: DataFrame, plan: Plan, key: str, record: Column, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """Add the shard (0 for keys that aren't split) and the task's slot of each row; null keys count as light.

    A light key's slot is an element of an array; only split keys, at most 1/share, are looked up by value.
    """
    some = next(iter(plan.slots.values()), 0)
    groups = F.array(*[F.lit(plan.slots.get(("", g), some)) for g in range(plan.groups)])
    light = F.element_at(groups, F.pmod(F.hash(F.col(key)), F.lit(plan.groups)) + 1)
    if not plan.shards:
        return rows.withColumn(shard, F.lit(0)).withColumn(slot, light)
    heavy = F.coalesce(F.col(key).isin(list(plan.shards)), F.lit(False))
    own = {k: F.array(*[F.lit(plan.slots[k, s]) for s in range(n)]) for k, n in plan.shards.items()}
    slots = F.element_at(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)]), F.col(key))
    sharded = rows.withColumn(shard, F.when(heavy, F.pmod(F.xxhash64(record), F.size(slots).cast("long")).cast("int")).otherwise(F.lit(0)))
    return sharded.withColumn(slot, F.when(heavy, F.element_at(slots, F.col(shard) + 1)).otherwise(light))


def replicate(side: DataFrame, plan: Plan, key: str, shard: str = "shard") -> DataFrame:
    """The matching side, with one copy per shard of split keys and one row for every other key."""
    count = F.coalesce(_lookup(plan.shards, F.col(key), "int"), F.lit(1))
    return side.withColumn(shard, F.explode(F.sequence(F.lit(0), count - 1)))


def fragment_replicate_join(big: DataFrame, side: DataFrame, plan: Plan, key: str, record: Column, how: str = "inner", on: tuple[str, ...] = ()) -> DataFrame:
    """Join on ``key`` (and ``on``) so that no task gets more than its share of a hot key. Null keys match nothing."""
    left = with_slot(big, plan, key, record).drop("slot")
    return left.join(replicate(side, plan, key), [key, "shard", *on], how).drop("shard")


def heavy_shards(loads: DataFrame, share: float = SHARE) -> dict:
    """Shards of the keys of ``loads(key, load)`` that hold more than ``share`` of all rows: at most 1/share keys."""
    total = loads.agg(F.sum("load")).first()[0] or 0
    return {k: -(-n // max(1, int(share * total))) for k, n in loads.where(F.col("load") > share * total).collect()}


def spread_join(big: DataFrame, side: DataFrame, key: str, record: Column, shards: dict, how: str = "inner") -> DataFrame:
    """Join on ``key``: rows of the keys in ``shards`` go to a shard by their record, the side's rows to every shard of theirs."""
    count = lambda: F.coalesce(_lookup(shards, F.col(key), "int"), F.lit(1))
    left = big.withColumn("__shard", F.pmod(F.xxhash64(record), count().cast("long")).cast("int") if shards else F.lit(0))
    right = side.withColumn("__shard", F.explode(F.sequence(F.lit(0), count() - 1)) if shards else F.lit(0))
    return left.join(right, [key, "__shard"], how).drop("__shard")


def sized_join(big: DataFrame, side: DataFrame, key: str, record: Column, row_bytes: Column, how: str = "inner") -> DataFrame:
    """Join on ``key`` with a side that is measured first: up to BROADCAST_BYTES it is broadcast, else heavy keys are spread.

    ``row_bytes`` is the size of a row of the side apart from its key; ``side`` is read twice, so it should be written.
    """
    size = side.agg(F.sum(row_bytes.cast("long") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return big.join(F.broadcast(side), key, how)
    return spread_join(big, side, key, record, heavy_shards(key_loads(big, key)), how)


def balanced_counts(rows: DataFrame, plan: Plan, key: str, record: tuple[str, ...], amount: str, n_rows: str) -> DataFrame:
    """``key_value, pages, occurrences, n_rows`` of each key: distinct records, sum of amounts and of row numbers.

    Rows move once, to their planned task by the slot's hash, and are counted per record and key there; the shards of a
    split key meet as one partial row each. Repeated rows count in ``n_rows`` and ``occurrences``, once in ``pages``; a
    null record counts in no page; null keys are no keys.
    """
    known = F.coalesce(*[F.col(r) for r in record])
    placed = with_slot(rows.where(F.col(key).isNotNull()), plan, key, known).repartition(plan.tasks, "slot")
    per_record = placed.groupBy("slot", "shard", F.col(key).alias("key_value"), *record).agg(F.sum(amount).alias("occurrences"), F.sum(n_rows).alias("n_rows"))
    partial = per_record.groupBy("slot", "shard", "key_value").agg(F.count(record[0]).alias("pages"), F.sum("occurrences").alias("occurrences"), F.sum("n_rows").alias("n_rows"))
    return partial.groupBy("key_value").agg(F.sum("pages").alias("pages"), F.sum("occurrences").alias("occurrences"), F.sum("n_rows").alias("n_rows"))


def key_report(spark: SparkSession, postings: DataFrame, tasks: int | None = None) -> DataFrame:
    """``field_name, key_value, pages, occurrences, n_rows, row_share`` of every index term and every site of postings.

    A page is a crawl key. ``row_share`` is the part of all rows of postings, repeated rows included. An empty table
    gives no rows. Sites are counted from their pages' sums, terms from the rows.
    """
    from siltworks.functions.urls import page_key, site_of
    from siltworks.operators.postings import index_term, occurrences, record_of, with_pages

    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = postings.select("term", "url", "frequency", "positions")
    named = lambda field, c: F.concat(F.lit(f"{field}\u0002"), c).alias("k")
    rows = with_pages(own.where(F.trim("term") != ""), "left")
    terms = rows.select(named("term", index_term(F.col("term"))), "record", "record_2", occurrences(rows).alias("n"), F.lit(1).cast("long").alias("m"))
    per_url = own.groupBy("url").agg(F.sum(occurrences(own)).alias("n"), F.count("*").alias("m")).withColumn("page", page_key(F.col("url")))
    sites = per_url.where(site_of(F.col("page")) != "").select(named("site", site_of(F.col("page"))), *record_of(F.col("page")), "n", "m")
    both = terms.unionByName(sites)
    loads = own.where(F.trim("term") != "").groupBy(named("term", index_term(F.col("term"))).alias("key")).agg(F.count("*").alias("load")).unionByName(sites.groupBy(F.col("k").alias("key")).agg(F.sum("m").alias("load")))
    plan = plan_tasks(spark, loads, tasks)
    counts = balanced_counts(both, plan, "k", ("record", "record_2"), "n", "m")
    total = postings.agg(F.count("*").alias("total"))
    split = counts.select(
        F.substring_index("key_value", "\u0002", 1).alias("field_name"), F.expr("substring(key_value, 6)").alias("key_value"), "pages", "occurrences", "n_rows"
    )
    return split.crossJoin(F.broadcast(total)).withColumn("row_share", F.col("n_rows") / F.col("total")).drop("total")
