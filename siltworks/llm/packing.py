"""Laying token sequences into containers of fixed capacity.

The lengths' global histogram (at most ``capacity`` entries) goes to the driver. Dynamic programming chooses length
buckets that minimise padding, and token-budget batches are formed from whole buckets: a batch pattern says how many
items of which buckets fill a container and how often it repeats. Items find their container by their rank inside
their bucket, which is counted in shards, so that neither a common length nor the driver holds many rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.tokens import TOKENIZER, token_counts
from siltworks.session import ensure_checkpoint_dir

BUCKETS = 128
#: Distinct pack names at most: the pack's number has ten bits of a sort key.
PACKS = 1024
#: Items of a common length that one task ranks; more items make more shards.
TASK_ITEMS = 200_000
RANK_BITS = 40


def length_buckets(lengths: np.ndarray, counts: np.ndarray, most: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most ``most`` buckets over sorted distinct lengths with the least padding.

    cost(i, j) pads lengths i..j-1 to the last of them; for a fixed number of buckets each layer of the recurrence is
    a lower envelope of lines whose slopes and queries both grow, so a layer takes linear time.
    """
    m = len(lengths)
    if m <= most:
        return lengths
    x = [float(v) for v in lengths]
    n = np.concatenate([[0.0], np.cumsum(counts, dtype=float)]).tolist()
    s = np.concatenate([[0.0], np.cumsum(lengths * counts, dtype=float)]).tolist()
    best = [0.0] + [x[j - 1] * n[j] - s[j] for j in range(1, m + 1)]
    back = []
    for k in range(2, most + 1):
        hull: list[tuple[float, float, int]] = []
        at, new, frm = 0, [float("inf")] * (m + 1), [0] * (m + 1)
        for j in range(k, m + 1):
            i = j - 1
            a, b = -n[i], best[i] + s[i]
            while len(hull) >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - a) >= (b - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                hull.pop()
            hull.append((a, b, i))
            at = min(at, len(hull) - 1)
            q = x[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * q + hull[at + 1][1] <= hull[at][0] * q + hull[at][1]:
                at += 1
            new[j] = hull[at][0] * q + hull[at][1] + q * n[j] - s[j]
            frm[j] = hull[at][2]
        back.append(frm)
        best = new
    ends, j = [], m
    for frm in reversed(back):
        ends.append(j)
        j = frm[j]
    ends.append(j)
    return lengths[np.array(sorted(ends)) - 1]


def batch_patterns(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(repeats, [(bucket, items)])``: fill a container from the largest bucket downwards, repeat while items last."""
    left = counts.astype(np.int64).copy()
    out = []
    while left.any():
        room, use = capacity, []
        k = len(bounds) - 1
        while k >= 0:
            k = min(k, int(np.searchsorted(bounds, room, side="right")) - 1)
            while k >= 0 and left[k] == 0:
                k -= 1
            if k < 0:
                break
            items = min(int(left[k]), room // int(bounds[k]))
            use.append((k, items))
            room -= items * int(bounds[k])
            k -= 1
        repeats = min(int(left[k]) // items for k, items in use)
        for k, items in use:
            left[k] -= repeats * items
        out.append((repeats, use))
    return out


def _assignment(patterns: list[tuple[int, list[tuple[int, int]]]], pack: int, base: int) -> list[tuple[int, ...]]:
    """Rank intervals: (sort key of pack, bucket and first rank; first rank; items per container; first container; place)."""
    used: dict[int, int] = {}
    out = []
    for repeats, use in patterns:
        place = 0
        for k, items in use:
            start = used.get(k, 0)
            out.append(((pack * 8192 + k) << RANK_BITS | start, start, items, base, place))
            used[k] = start + items * repeats
            place += items
        base += repeats
    return out


def pack_documents(documents: DataFrame, pack_sizes: DataFrame, path: str = TOKENIZER, buckets: int = BUCKETS, shards: int | None = None) -> DataFrame:
    """``pack_name, capacity, doc_id, piece, token_start, n_tokens, container_id, place``.

    Every document with at least one token is placed once in each pack; only documents longer than the capacity are
    split, into pieces of the full capacity and a rest. Null and empty texts have no tokens and are left out; repeated
    rows are placed as rows of their own; packs of a null or non-positive capacity, or of a repeated name, are
    ignored but for the name's first; more than PACKS names raise a ValueError; empty tables give no rows.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    sizes = token_counts(documents, path).where("n_tokens > 0").checkpoint()
    usable = pack_sizes.select("pack_name", F.col("capacity").cast("int")).where("capacity > 0 and pack_name is not null")
    packs = dict(sorted(map(tuple, usable.groupBy("pack_name").agg(F.min("capacity")).limit(PACKS + 1).collect())))
    if len(packs) > PACKS:
        raise ValueError(f"more than {PACKS} pack names")
    names = list(packs)
    if not names:
        return sizes.limit(0).selectExpr("string(null) pack_name", "0 capacity", "doc_id", "0 piece", "0L token_start", "0 n_tokens", "0L container_id", "0 place")
    choice = F.array(*[F.struct(F.lit(i).alias("pack"), F.lit(n).alias("pack_name"), F.lit(packs[n]).alias("capacity")) for i, n in enumerate(names)])
    items = (
        sizes.withColumnRenamed("n_tokens", "total")
        .select("doc_id", "total", F.inline(choice))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr("(total - 1) div capacity").cast("int"))))
        .withColumn("n_tokens", F.least(F.col("capacity"), F.col("total") - F.col("piece") * F.col("capacity")))
    )
    histogram = items.groupBy("pack", "n_tokens").agg(F.count("*").alias("n")).toPandas()
    shards = shards or max(8, int(histogram["n"].sum()) // TASK_ITEMS)
    bounds, rows = {}, []
    for i, name in enumerate(names):
        own = histogram[histogram["pack"] == i].sort_values("n_tokens")
        lengths, counts = own["n_tokens"].to_numpy(), own["n"].to_numpy()
        bounds[i] = length_buckets(lengths, counts, buckets) if len(own) else np.array([packs[name]])
        per = np.bincount(np.searchsorted(bounds[i], lengths), weights=counts, minlength=len(bounds[i])).astype(np.int64)
        rows += _assignment(batch_patterns(bounds[i], per, packs[name]), i, 0)
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)

    @F.pandas_udf("int")
    def bucket_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pack, n in batches:
            out = np.zeros(len(pack), np.int32)
            for i, b in bounds.items():
                own = (pack == i).to_numpy()
                out[own] = np.searchsorted(b, n.to_numpy()[own])
            yield pd.Series(out)

    @F.pandas_udf("container_id long, place int")
    def placed(pack: pd.Series, bucket: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = rank.to_numpy()
        at = np.searchsorted(table[:, 0], (pack.to_numpy().astype(np.int64) * 8192 + bucket.to_numpy()) << RANK_BITS | r, side="right") - 1
        since, per = r - table[at, 1], table[at, 2]
        return pd.DataFrame({"container_id": table[at, 3] + since // per, "place": (table[at, 4] + since % per).astype(np.int32)})

    bucketed = items.withColumn("bucket", bucket_of("pack", "n_tokens")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    per_shard = bucketed.groupBy("pack", "bucket", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pack", "bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_shard.select("pack", "bucket", "shard", before.alias("before"))  # packs * buckets * shards rows at most
    in_shard = F.row_number().over(Window.partitionBy("pack", "bucket", "shard").orderBy("doc_id", "piece"))
    ranked = bucketed.withColumn("row", in_shard).join(F.broadcast(offsets), ["pack", "bucket", "shard"]).withColumn("rank", F.col("before") + F.col("row") - 1)
    start = F.col("piece").cast("long") * F.col("capacity")
    return ranked.withColumn("to", placed("pack", "bucket", "rank")).select(
        "pack_name", "capacity", "doc_id", "piece", start.alias("token_start"), "n_tokens", "to.container_id", "to.place"
    )


def container_fill(packed: DataFrame) -> DataFrame:
    """``pack_name, capacity, containers, tokens, fill`` of each pack."""
    per = packed.groupBy("pack_name", "capacity").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return per.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))
