"""Connected components by contraction: every round merges each node into its least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import drop_settled, join_spread, settle


#: Edges of one node that one task may get in a round.
NODE_EDGES = 1 << 16


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a long, b long); component: the smallest node reachable.

    Order among nodes is a hash that differs by round, so long chains shrink by a constant factor in expectation
    and the number of rounds is logarithmic whatever the ids are. A round is a min per node (map-side combined, so a
    node with a third of all edges is one row per task) and two joins of the edges to the nodes' parents. Spanning
    forests are stars, so in all joins the rows of frequent nodes of over NODE_EDGES edges stay where they are and
    get what they need by broadcast. Null ends, self links and repeated edges are ignored; an empty table gives an empty table.
    """
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    spark, levels, turn = edges.sparkSession, [], 0
    while not edges.isEmpty():
        rank = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))
        ends = edges.select("a", "b", F.lit(True).alias("own")).unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(False)))
        least = ends.groupBy("a").agg(F.min(rank("b")).alias("m"), F.count_if("own").alias("n_a"), F.count_if(~F.col("own")).alias("n_b"))
        parents = settle(least.select(F.col("a").alias("node"), F.least("m", rank("a"))["n"].alias("parent"), "n_a", "n_b"))
        pa = parents.where("n_a > 0").select(F.col("node").alias("a"), F.col("parent").alias("pa"), F.col("n_a").alias("n"))
        pb = parents.where("n_b > 0").select(F.col("node").alias("b"), F.col("parent").alias("pb"), F.col("n_b").alias("n"))
        half = settle(join_spread(edges, pa, "a", least=NODE_EDGES))
        lifted = join_spread(half, pb, "b", least=NODE_EDGES).where("pa <> pb")
        following = settle(lifted.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        drop_settled(edges, half)
        levels.append(parents)
        edges, turn = following, turn + 1
    drop_settled(edges)
    if not levels:
        return spark.createDataFrame([], "node long, component long")
    labels = levels[-1].select("node", F.col("parent").alias("label"))
    for level in reversed(levels[:-1]):
        upper = labels.select(F.col("node").alias("parent"), "label")
        sizes = level.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
        named = settle(sizes.join(upper, "parent", "left").select("parent", "n", F.coalesce("label", "parent").alias("label")))
        labels = settle(join_spread(level.select("node", "parent"), named, "parent", least=NODE_EDGES).select("node", "label"))
        drop_settled(named)
    labels = settle(labels)
    drop_settled(*levels)
    least = settle(labels.groupBy("label").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")))
    return join_spread(labels, least, "label").select("node", "component")
