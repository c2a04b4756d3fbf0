"""Connected components of a table of links, by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, delete, fresh_path


def _with_least(edges: DataFrame, least: DataFrame, paths: list[str] | None) -> DataFrame:
    """edges with the number m of their u. Few edges (no paths) take a broadcast; of many both sides are dealt out anew, so that a hub's edges can be split.

    The size that Spark expects of a join is the product of its sides' sizes, and a checkpoint hands it on: with a checkpoint on
    either side its digits doubled twice a round, until the driver could not hold the number. Files have the size that they have.
    """
    if paths is None:
        return edges.join(F.broadcast(least), "u")
    paths.append(fresh_path(edges.sparkSession, "least"))
    least.write.parquet(paths[-1])
    return edges.join(edges.sparkSession.read.schema(least.schema).parquet(paths[-1]).hint("merge"), "u")


def _large_star(edges: DataFrame, paths: list[str] | None) -> DataFrame:
    """Every neighbour above a node is tied to the node's smallest neighbour."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return _with_least(both, least, paths).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, paths: list[str] | None) -> DataFrame:
    """A node and its neighbours below are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = _with_least(edges, least, paths).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, max_rounds: int = 60, rows_per_task: int = 200_000) -> DataFrame:
    """(node, label) for every node of links (a long, b long); label is the smallest node of its component.

    Null ends, self links and repeated links change nothing; no links give no rows. The number of
    rounds grows with the logarithm of the longest path. Raises if max_rounds do not suffice. Up to
    rows_per_task edges are handled in one task, with broadcasts of their nodes; more are joined by shuffle.
    """
    edges = checkpointed(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = max(1, -(-edges.count() // rows_per_task))  # a round never has more edges than the links, so a few stay a few
    edges, before = edges.coalesce(n), None
    for _ in range(max_rounds):
        paths = None if n == 1 else []
        edges = checkpointed(_small_star(_large_star(edges, paths).coalesce(n), paths).coalesce(n))
        for path in paths or ():
            delete(edges.sparkSession, path)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
