"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, give_back_driver, written


def _dealt(node: str) -> Column:
    """The key of a round's joins: another than that of its sums, so that both sides are dealt for the join and Spark can split a hub.

    Never null: what a join infers about null keys it says to some readers of a table only, and equal exchanges would run apart.
    """
    return F.coalesce(F.bitwise_not(node), F.lit(0).cast("long"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it; edges come with a > b, and so the least is b or below it."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(_dealt("a").alias("k"), "m")
    # not broadcast: a round's tables would each pass through the driver, with a job and a thread of their own
    moved = edges.join(least.hint("merge"), _dealt("b") == F.col("k"), "left")
    return moved.select("a", F.coalesce("m", "b").alias("b"))  # as many as links; what repeats goes at the round's end


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; edges come with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(_dealt("a").alias("k"), "m")
    moved = edges.join(least.hint("merge"), _dealt("a") == F.col("k"))
    # the neighbours' links, and the node's own from the row that has its smallest neighbour
    return moved.select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct links with a > b are stars: a node has one link down, or any number up, and so is linked to its component's least."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    by_node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return by_node.agg(F.max(F.col("down") + F.col("up"))).first()[0] in (None, 1)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links between long ids -> (node, component): the smallest id that is reachable, for every linked node.

    Self-links, null ends, repeated links and either direction are fine; unlinked nodes do not appear. A hub's links are
    never gathered: each round joins links to one minimum per node, whose large partitions Spark can split. Every
    round is written to the shared folder, so that a lost executor costs no earlier round. Rounds end as soon as the links are
    stars, and none is run for links that are.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    for _ in range(max_rounds):
        if _settled(now):
            give_back_driver(now.sparkSession)
            roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
        nxt = written(_small_star(_large_star(now)), "links")
        forget(now)
        now = nxt
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
