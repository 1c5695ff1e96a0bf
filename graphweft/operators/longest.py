"""Values carried along the edges of a graph to all that they reach, in rounds that don't follow the length of its chains."""

from __future__ import annotations

from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.operators.spread import join_spread
from graphweft.storage import drop_settled, settle

#: What becomes of a value along an edge and where several meet: the largest sum with the edges' weights, the largest, or all bits.
LONGEST, GREATEST, MARKS = "longest", "greatest", "marks"


#: So many nodes and edges at most that are left of a graph are finished in one task.
FEW = 1 << 16


class _Kinds:
    """Column expressions over the values' kinds."""

    def __init__(self, values: dict[str, str]) -> None:
        self.values, self.names = values, list(values)

    def along(self, name: str, value: Column, weight: Column) -> Column:
        return value + weight if self.values[name] == LONGEST else value

    def met(self, name: str, a: Column, b: Column) -> Column:
        """Of a, and of b where there is one."""
        return F.when(b.isNull(), a).otherwise(a.bitwiseOR(b) if self.values[name] == MARKS else F.greatest(a, b))

    def gathered(self, name: str, value: Column) -> Column:
        return F.bit_or(value) if self.values[name] == MARKS else F.max(value)

    def columns(self, prefix: str = "") -> list[Column]:
        return [F.col(n).alias(prefix + n) for n in self.names]


def _jumped(single: DataFrame, kinds: _Kinds) -> DataFrame:
    """(node, to, w, values, open) of nodes (node, to, w, values) with one way in: to is the nearest node before it with another number of ways.

    Doubling: each round takes the way of the node that it leads to, weights and values composed, so rounds are the
    logarithm of the longest chain. What is still open then is in or behind a cycle of such nodes.
    """
    now = settle(single.withColumn("open", F.lit(True)))
    rounds = now.count().bit_length() + 1
    for _ in range(rounds):
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("w").alias("_w"), *kinds.columns("_"))
        met = join_spread(now.where("open"), ahead, "to").select(
            "node", F.coalesce("_to", "to").alias("to"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"),
            *(kinds.met(n, F.col(n), kinds.along(n, F.col(f"_{n}"), F.col("w"))).alias(n) for n in kinds.names), F.col("_to").isNotNull().alias("open"),
        )
        following = settle(now.where("not open").unionByName(met))
        drop_settled(now)
        now = following
        if now.where("open").isEmpty():
            break
    return now


def _in_one_task(left: DataFrame, ways: DataFrame, kinds: _Kinds) -> DataFrame:
    """(node, values) as carried() gives them, of FEW nodes and edges at most: by a queue of what has no way in any more."""
    key = lambda c: F.to_json(F.struct(F.col(c).alias("k")))
    keyed = left.withColumn("_key", key("node"))
    rows = keyed.select("_key", F.lit(None).cast("string").alias("_to"), F.lit(None).cast("long").alias("_w"), *kinds.names)
    rows = rows.unionByName(ways.select(key("src").alias("_key"), key("dst").alias("_to"), F.col("w").alias("_w")), allowMissingColumns=True)
    how = list(kinds.values.values())

    def run(batches):
        values, ahead, into = {}, defaultdict(list), defaultdict(int)
        for batch in batches:
            for k, to, w, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if to is None:
                    values[k] = own
                else:
                    ahead[k].append((to, w))
                    into[to] += 1
        free, out = deque(k for k in values if not into[k]), []
        while free:
            k = free.popleft()
            out.append((k, *values[k]))
            for to, w in ahead[k]:
                has = values[to]
                for i, (kind, x) in enumerate(zip(how, values[k], strict=True)):
                    has[i] = has[i] | x if kind == MARKS else max(has[i], x + w if kind == LONGEST else x)
                into[to] -= 1
                if not into[to]:
                    free.append(to)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["_key", *kinds.names])

    found = rows.coalesce(1).mapInArrow(run, ", ".join(["_key string", *(f"{n} long" for n in kinds.names)]))
    return keyed.select("node", "_key").join(found, "_key").select("node", *kinds.names)


def carried(nodes: DataFrame, edges: DataFrame, values: dict[str, str]) -> DataFrame:
    """(node, values) of every node that no cycle leads to: its own values and all that come to it along the edges.

    nodes: node, and a long column for each of values (name: kind); edges: src, dst, w (long), ends among the nodes. Each
    round does two things. Nodes without a way in are settled, and their values go on to the nodes behind them. Nodes
    with one way in are taken out, as chains and whole trees at once (see _jumped): they are settled too if what they
    hang on is; else ways out of them lead out of that node instead, with the weights added, which makes no more edges,
    and in the end they get their values from it.
    So chains and trees take rounds by the logarithm of their depth, others one for each node that ways meet in, in a
    row. Once FEW nodes and edges are left, one task finishes them. A node with a large part of all edges is no task's (see
    join_spread). Null ends are ignored.
    """
    kinds = _Kinds(values)
    ways = settle(edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.max("w").cast("long").alias("w")))
    left = settle(nodes.where("node is not null").select("node", *kinds.names))
    done, waiting = left.select("node", *kinds.names).where("false"), []
    while True:
        if ways.count() <= FEW and left.count() <= FEW:
            done = done.unionByName(_in_one_task(left, ways, kinds))
            break
        into = ways.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("to"), F.max("w").alias("w"))
        known = settle(left.join(into, "node", "left"))
        free, single = known.where("n is null"), known.where("n = 1")
        done = done.unionByName(free.select("node", *kinds.names))
        if known.where("n is not null").isEmpty():
            break
        jumped = _jumped(single.select("node", "to", "w", *kinds.names), kinds)
        closed = jumped.where("not open").drop("open")
        if free.isEmpty() and closed.isEmpty():
            break  # only cycles and what they lead to
        # What leads out of a free node is settled with it.
        met = settle(join_spread(closed, free.select(F.col("node").alias("to"), F.lit(True).alias("_free"), *kinds.columns("_")), "to"))
        after_free = met.where("_free").select("node", *(kinds.met(n, F.col(n), kinds.along(n, F.col(f"_{n}"), F.col("w"))).alias(n) for n in kinds.names))
        later = met.where("_free is null").select("node", "to", "w", *kinds.names)
        waiting.append(later)
        done = done.unionByName(after_free)
        # gone: settled nodes lead nowhere any more, the others out of the node before them
        ended = free.select("node", *kinds.names).unionByName(after_free).select(F.col("node").alias("src"), F.lit(None).cast(known.schema["to"].dataType).alias("to"), F.lit(0).cast("long").alias("_w"), *kinds.columns())
        gone = settle(ended.unionByName(later.select(F.col("node").alias("src"), "to", F.col("w").alias("_w"), *kinds.columns())))
        kept = settle(ways.join(closed.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "w"))
        moved = settle(join_spread(kept, gone, "src"))
        sent = moved.where("_w is not null").groupBy(F.col("dst").alias("node")).agg(*(kinds.gathered(n, kinds.along(n, F.col(n), F.col("w"))).alias(f"_{n}") for n in kinds.names))
        rest = known.where("n > 1").select("node", *kinds.names).unionByName(jumped.where("open").select("node", *kinds.names))
        after = settle(rest.join(sent, "node", "left").select("node", *(kinds.met(n, F.col(n), F.col(f"_{n}")).alias(n) for n in kinds.names)))
        onward = moved.where("_w is null or to is not null").select(F.coalesce("to", "src").alias("src"), "dst", (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"))
        following = settle(onward.groupBy("src", "dst").agg(F.max("w").alias("w")))
        drop_settled(ways, left, kept, moved, gone)
        ways, left = following, after
    for level in reversed(waiting):
        upper = settle(done.select(F.col("node").alias("to"), *kinds.columns("_")))
        found = join_spread(level, upper, "to", "inner").select("node", *(kinds.met(n, F.col(n), kinds.along(n, F.col(f"_{n}"), F.col("w"))).alias(n) for n in kinds.names))
        done = settle(done.unionByName(found))
    return done
