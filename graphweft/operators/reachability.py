"""Does one node lead to another: an index of labels that answers most pairs by a comparison, and a walk for the rest."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.operators.graph import strong_components
from graphweft.operators.longest import GREATEST, LONGEST, MARKS, carried
from graphweft.operators.spread import join_spread
from graphweft.storage import drop_settled, settle

#: Bits of a label of landmarks, and random orders.
LANDMARKS, ORDERS = 62, 3
_VALUES = {"layer": LONGEST, "marks": MARKS} | {f"order{i}": GREATEST for i in range(ORDERS)}


class ReachIndex:
    """Written tables: components (node, component), wires between components (src, dst), labels (component, up_*, down_*)."""

    def __init__(self, components: DataFrame, wires: DataFrame, labels: DataFrame) -> None:
        self.components, self.wires, self.labels = components, wires, labels


def reach_index(edges: DataFrame) -> ReachIndex:
    """Labels of a graph (src, dst) whose components are condensed first; built once for any number of questions.

    A node's up labels are gathered from all that leads to it, itself included, its down labels from all that it leads
    to: the longest way, the largest of its numbers in each of ORDERS random orders, and which of LANDMARKS nodes with
    most ways in and out are among them. Both are carried along the wires (see longest.carried). Null ends are ignored.
    """
    edges = settle(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    components = settle(strong_components(edges))
    a, b = components.select(F.col("node").alias("src"), F.col("component").alias("a")), components.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    half = settle(join_spread(edges, a, "src", "inner"))
    wires = settle(join_spread(half, b, "dst", "inner").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    drop_settled(edges, half)
    nodes = components.select(F.col("component").alias("node")).distinct()
    ends = wires.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(wires.select("dst", F.lit(0), F.lit(1)))
    busy = ends.groupBy("node").agg((F.sum(F.col("o").cast("double")) * F.sum("i")).alias("ways")).orderBy(F.desc("ways"), "node").limit(LANDMARKS).select("node").collect()
    landmarks = edges.sparkSession.createDataFrame([(r["node"], 1 << i) for i, r in enumerate(busy)], nodes.withColumn("marks", F.lit(0).cast("long")).schema)
    known = nodes.join(F.broadcast(landmarks), "node", "left").select(
        "node", F.lit(0).cast("long").alias("layer"), F.coalesce("marks", F.lit(0)).cast("long").alias("marks"), *(F.xxhash64("node", F.lit(i)).alias(f"order{i}") for i in range(ORDERS))
    )
    known = settle(known)
    one = F.lit(1).alias("w")
    up = carried(known, wires.select("src", "dst", one), _VALUES).withColumnsRenamed({n: f"up_{n}" for n in _VALUES})
    down = carried(known, wires.select(F.col("dst").alias("src"), F.col("src").alias("dst"), one), _VALUES).withColumnsRenamed({n: f"down_{n}" for n in _VALUES})
    return ReachIndex(components, wires, settle(up.join(down, "node").withColumnRenamed("node", "component")))


def _told(a: str, b: str) -> Column:
    """Whether the component with labels prefixed a leads to the one with labels prefixed b: true, false, or null where labels don't tell."""
    up = lambda side, n: F.col(f"{side}up_{n}")
    down = lambda side, n: F.col(f"{side}down_{n}")
    same = F.col(f"{a}component") == F.col(f"{b}component")
    # What leads to a would lead to b as well, and a would lead to all that b leads to.
    orders = [up(a, f"order{i}") <= up(b, f"order{i}") for i in range(ORDERS)] + [down(b, f"order{i}") <= down(a, f"order{i}") for i in range(ORDERS)]
    within = lambda x, y: x.bitwiseAND(y) == x
    may = reduce(and_, [up(a, "layer") < up(b, "layer"), down(a, "layer") > down(b, "layer"), within(up(a, "marks"), up(b, "marks")), within(down(b, "marks"), down(a, "marks")), *orders])
    # A landmark lies between them.
    surely = reduce(or_, [same, down(a, "marks").bitwiseAND(up(b, "marks")) != 0])
    return F.when(surely, True).when(~may, False)


def _labelled(rows: DataFrame, labels: DataFrame, of: str, prefix: str) -> DataFrame:
    """rows with the labels of the component in the column of, prefixed."""
    return join_spread(rows, labels.select(F.col("component").alias(of), *(F.col(c).alias(prefix + c) for c in labels.columns)), of)


def trace_pairs(pairs: DataFrame, index: ReachIndex) -> DataFrame:
    """(a, b, reaches, walked) of each distinct pair (a, b): whether a leads to b along the wires, and whether labels didn't tell.

    Every node leads to itself. Labels are exact where they tell: no pair is answered wrongly by them. The other pairs walk
    from a, past the nodes only whose labels don't exclude b, until labels tell; a round is a hop of all such pairs
    together. Pairs with a null are left out; a node that no wire touches leads to itself only.
    """
    asked = settle(pairs.where("a is not null and b is not null").select("a", "b").distinct())
    named = lambda of, to: index.components.select(F.col("node").alias(of), F.col("component").alias(to))
    half = settle(join_spread(asked, named("a", "ca"), "a"))
    met = settle(join_spread(half, named("b", "cb"), "b"))
    sided = settle(_labelled(met, index.labels, "ca", "a_"))
    told = settle(_labelled(sided, index.labels, "cb", "b_").withColumn("reaches", F.when(F.col("a") == F.col("b"), True).when(F.col("ca").isNull() | F.col("cb").isNull(), False).otherwise(_told("a_", "b_"))))
    drop_settled(half, met, sided)
    open_pairs = settle(told.where("reaches is null").select("ca", "cb").distinct())
    targets = settle(open_pairs.select("cb").distinct().join(index.labels.select(F.col("component").alias("cb"), *(F.col(c).alias("b_" + c) for c in index.labels.columns)), "cb"))
    frontier, seen, yes = settle(open_pairs.withColumn("at", F.col("ca"))), None, open_pairs.where("false")
    seen = frontier
    while not frontier.isEmpty():
        hop = settle(frontier.join(index.wires.withColumnRenamed("src", "at"), "at").select("ca", "cb", F.col("dst").alias("at")).distinct().join(seen, ["ca", "cb", "at"], "left_anti"))
        here = settle(_labelled(hop, index.labels, "at", "a_"))
        judged = settle(join_spread(here, targets, "cb", "inner").select("ca", "cb", "at", _told("a_", "b_").alias("reaches")))
        drop_settled(hop, here)
        found = settle(judged.where("reaches").select("ca", "cb").distinct())
        yes = yes.unionByName(found)
        frontier = settle(judged.where("reaches is null").select("ca", "cb", "at").join(found, ["ca", "cb"], "left_anti"))
        drop_settled(judged)
        seen = seen.unionByName(frontier)
    walked = settle(yes.distinct()).withColumn("found", F.lit(True))
    out = told.join(walked, ["ca", "cb"], "left")
    return out.select("a", "b", F.coalesce("reaches", "found", F.lit(False)).alias("reaches"), F.col("reaches").isNull().alias("walked"))
