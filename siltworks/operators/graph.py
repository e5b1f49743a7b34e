"""Link graph and PageRank."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.urls import index_key
from siltworks.session import ensure_checkpoint_dir

# Damping, greatest movement of a rank at the end, most rounds.
DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-4, 50


def link_graph(pages: DataFrame) -> DataFrame:
    """``src, dst``: distinct links between index keys whose target is a stored url; self-links stay."""
    visited = pages.select(F.col("url").alias("dst")).where("dst is not null").distinct()
    links = pages.select(index_key(pages["url"]).alias("src"), F.explode("links").alias("link")).select("src", index_key(F.col("link")).alias("dst"))
    return links.where("src is not null and dst is not null").distinct().join(visited, "dst", "left_semi").select("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """``node, out_degree, in_degree``."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return out.join(into, "node", "full").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without outgoing edges."""
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = ROUNDS, cut_every: int = 5) -> DataFrame:
    """``node, rank``: synchronous PageRank; dangling rank is spread evenly; edges from or to other nodes are ignored.

    Stops when no rank moves by more than ``tolerance``. Edges are kept with their source's degree, partitioned by
    source; a round is one join on the source and one aggregation by target. Contributions are combined before the
    shuffle, so a target with a third of all links costs one row per task. Lineage is cut by reliable checkpoints.
    """
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    nodes = nodes.select("node").where("node is not null").distinct()
    inside = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").distinct()
    out = inside.groupBy("src").agg(F.count("*").alias("out_degree"))
    kept = inside.join(out, "src").repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    n = nodes.count()
    ranks = nodes.join(out.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("out_degree").isNull().alias("sink"), F.lit(1.0 / max(n, 1)).alias("rank")).checkpoint()
    on_sinks = lambda c: F.coalesce(F.sum(F.when(F.col("sink"), F.col(c))), F.lit(0.0))
    lost = ranks.agg(on_sinks("rank")).first()[0]
    held = None
    for i in range(rounds if n else 0):
        sent = kept.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out_degree")).alias("got"))
        base = (1 - damping) / n + damping * lost / n
        new = ranks.join(sent, "node", "left").select("node", "sink", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("new"), "rank")
        new = new.checkpoint() if i % cut_every == cut_every - 1 else new.persist(StorageLevel.MEMORY_AND_DISK)
        moved, lost = new.agg(F.max(F.abs(F.col("new") - F.col("rank"))), on_sinks("new")).first()
        if held is not None:
            held.unpersist()
        held = new
        ranks = new.select("node", "sink", F.col("new").alias("rank"))
        if moved <= tolerance:
            break
    out = ranks.select("node", "rank").checkpoint()
    kept.unpersist()
    if held is not None:
        held.unpersist()
    return out
