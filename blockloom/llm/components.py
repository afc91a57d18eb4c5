"""Connected components of a large edge list: alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import cut, join_spread

#: A star's centre is kept out of the shuffles from so many edges on.
HOT_EDGES = 10_000


def _looked_at(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether they are stars around their smallest nodes: no node is the larger end of two, or of one and the smaller of another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    met = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, bad = met.agg(F.sum("up"), F.count_if(F.col("up") + F.col("down") > 1)).first()
    return n or 0, not bad


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v) of longs; the root is the smallest node of its component.

    Each round is a few shuffles of the remaining edges and ends in a reliable checkpoint, so lineage stays short
    and lost executors cost one round.  Loops and repeated edges are allowed; no edges give no rows.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        n, settled = _looked_at(edges)
        if settled:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # The centre of a large star has as many edges: its rows are not dealt by it.
        large = join_spread(both.where("v > u"), low, ["u"], "n", 2 * n, HOT_EDGES).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        moved = F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col("m").alias("v")) for x in "uv"])).alias("e")
        edges = cut(small.select(moved).select("e.*").where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
