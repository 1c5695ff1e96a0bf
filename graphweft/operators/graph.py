"""Graph traversals: frontier loops whose state is a written table, never the driver's memory."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.operators.edges import code_flow
from graphweft.operators.longest import FEW, LONGEST, carried
from graphweft.operators.order import numbered
from graphweft.operators.spread import joined
from graphweft.storage import drop_settled, settle


#: Hops after which the files of a traversal's visited nodes are made one.
MERGE_HOPS = 8
#: Hops of colours that one step makes, as a step's start takes longer than a hop of few.
COLOUR_HOPS = 3
#: How many times the nodes that a root still needs its bound should leave.
SLACK = 3


def reach(starts: DataFrame, edges: DataFrame, most: int | None = None, full: int | None = None, settled: bool = False) -> DataFrame:
    """(root, node, hop) of all that each start reaches along (src, dst), itself at hop 0; cycles end.

    starts: root, node. A hop is an equi-join of the frontier and an anti-join with what was seen, whose files are made
    one now and then; at most most hops, and a root that has reached full nodes goes no further. settled: edges is a
    written table and isn't written again.
    """
    edges = edges if settled else settle(edges.select("src", "dst"))  # every hop reads this, not what made it
    frontier = settle(starts.select("root", "node").distinct().withColumn("hop", F.lit(0)))
    seen, hop, parts = frontier, 0, [frontier]
    while (most is None or hop < most) and not frontier.isEmpty():
        hop += 1
        live = frontier
        if full is not None:
            done = seen.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= full).select("root")
            live = frontier.join(done, "root", "left_anti")
        onward = joined(live, edges, live["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = settle(joined(onward, seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        parts.append(frontier)
        if len(parts) > MERGE_HOPS:
            whole = settle(seen.unionAll(frontier))
            drop_settled(*parts[:-1])
            parts, seen = [whole], whole
        else:
            seen = seen.unionAll(frontier)
    return seen


def trace(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, direction, hop): everything up and down the code wires of the starts (node). The wires are written once for both."""
    flow = settle(code_flow(edges).select("provider", "consumer"))
    one = starts.select(F.lit(0).alias("root"), "node")
    up = reach(one, flow.select(F.col("consumer").alias("src"), F.col("provider").alias("dst")), settled=True)
    down = reach(one, flow.select(F.col("provider").alias("src"), F.col("consumer").alias("dst")), settled=True)
    return up.select("node", F.lit("up").alias("direction"), "hop").unionAll(down.where("hop > 0").select("node", F.lit("down").alias("direction"), "hop"))


def traced_edges(traced: DataFrame, edges: DataFrame) -> DataFrame:
    """Code wires both of whose ends are on one side of a trace (up and down share the starts)."""
    side = lambda d: traced.where((F.col("direction") == d) | (F.col("hop") == 0)).select("node").distinct()
    own = lambda s: code_flow(edges).join(s.withColumnRenamed("node", "provider"), "provider", "left_semi").join(s.withColumnRenamed("node", "consumer"), "consumer", "left_semi")
    return own(side("up")).unionAll(own(side("down"))).distinct()


def _between(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) that others lead to and on from."""
    behind = joined(edges, edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    return joined(behind, edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def _bypassed(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(edges without some of the nodes with one way out, what was left out: node, onward, into array).

    A wire to such a node leads on to the node behind it. A coin by hash keeps two nodes in a row from going at once, so
    chains and long cycles shrink by a constant factor a round.
    """
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2))
    ways = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("onward"))
    single = ways.where("n = 1").select(F.col("src").alias("node"), "onward")
    after = single.select(F.col("node").alias("onward"), F.lit(True).alias("chained"))
    gone = settle(joined(single, after, "onward", "left").where((coin("node") == 0) & (F.col("chained").isNull() | (coin("onward") == 1))).select("node", "onward"))
    at = gone.select(F.col("node").alias("dst"), "onward")
    kept = joined(joined(edges, gone.select(F.col("node").alias("src")), "src", "left_anti"), at, "dst", "left")
    moved = kept.select("src", F.coalesce("onward", "dst").alias("dst"), F.when(F.col("onward").isNotNull(), F.col("dst")).alias("through"))
    moved = settle(moved)
    left_out = joined(gone, moved.where("through is not null").select(F.col("through").alias("node"), F.col("src").alias("into")), "node", "left").select("node", "onward", "into")
    return settle(moved.where("src <> dst").select("src", "dst").distinct()), settle(left_out)


def _components_in_one_task(left: DataFrame) -> DataFrame:
    """(node, c) of edges (src, dst), FEW at most: c is one node of each component. By two searches, the second one backwards."""
    key = lambda c: F.to_json(F.struct(F.col(c).alias("k")))

    def run(batches):
        ahead, behind = {}, {}
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ahead.setdefault(a, []).append(b)
                behind.setdefault(b, []).append(a)
        order, seen = [], set()
        for first in ahead:
            todo = [(first, iter(ahead[first]))] if first not in seen else []
            seen.add(first)
            while todo:
                node, onward = todo[-1]
                following = next((x for x in onward if x not in seen), None)
                if following is None:
                    order.append(node)
                    todo.pop()
                else:
                    seen.add(following)
                    todo.append((following, iter(ahead.get(following, ()))))
        of = {}
        for root in reversed(order):
            todo = [root] if root not in of else []
            while todo:
                node = todo.pop()
                if node not in of:
                    of[node] = root
                    todo += [x for x in behind.get(node, ()) if x not in of]
        if of:
            yield pa.RecordBatch.from_arrays([pa.array(list(of)), pa.array(list(of.values()))], ["_key", "_c"])

    named = left.select(F.col("src").alias("node")).unionAll(left.select("dst")).distinct().withColumn("_key", key("node"))
    found = left.select(key("src"), key("dst")).coalesce(1).mapInArrow(run, "_key string, _c string")
    return joined(joined(named, found, "_key"), named.select(F.col("_key").alias("_c"), F.col("node").alias("c")), "_c").select("node", "c")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each strongly connected component of (src, dst).

    Nodes without a way in or out among the remaining go at once, each a component of its own; nodes with one way out
    are bypassed, until few are. On what is left colours (the largest ancestor) spread forwards, and what reaches its
    colour's root backwards inside the colour is a component. A bypassed node belongs to the component behind it if a
    node before it does. Rounds follow the logarithm of chains and cycles, and the width of what has many ways. Once FEW
    edges are left, one task finishes them. All tables grow with the edges and none is broadcast, so that nothing of them
    passes through the driver round by round (see joined).
    """
    left = settle(edges.where("src <> dst").select("src", "dst").distinct())
    nodes = settle(edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct())
    found, levels, number = [], [], left.count()
    while number > FEW:
        kept = settle(_between(left))
        shorter, left_out = _bypassed(kept, len(levels))
        levels.append(left_out)
        drop_settled(left, kept)
        before, left, number = number, shorter, shorter.count()
        if number > 0.95 * before:
            break
    while number := left.count():
        if number <= FEW:
            found.append(settle(_components_in_one_task(left)))
            break
        while True:  # trim
            kept = settle(_between(left))
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        colour = settle(left.select(F.col("src").alias("node")).unionAll(left.select("dst")).distinct().withColumn("c", F.col("node")))
        while True:
            following = colour
            for _ in range(COLOUR_HOPS):
                spread = joined(left, following, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "c").unionAll(following)
                following = spread.groupBy("node").agg(F.max("c").alias("c"))
            following = settle(following)
            changed = not joined(following, colour, ["node", "c"], "left_anti").isEmpty()
            drop_settled(colour)
            colour = following
            if not changed:
                break
        a, b = colour.select(F.col("node").alias("src"), F.col("c").alias("sc")), colour.select(F.col("node").alias("dst"), F.col("c").alias("dc"))
        inside = settle(joined(joined(left, a, "src"), b, "dst").where("sc = dc").select("src", "dst", F.col("sc").alias("c")))
        back = reach(colour.where("node = c").select(F.col("c").alias("root"), "node"), inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        group = settle(back.select("node", F.col("root").alias("c")))
        found.append(group)
        gone = group.select("node")
        left = settle(joined(joined(left, gone, left["src"] == gone["node"], "left_anti"), gone, left["dst"] == gone["node"], "left_anti"))
    groups = nodes.select("node", F.col("node").alias("c")).where("false")
    for g in found:
        groups = groups.unionAll(g)
    for level in reversed(levels):  # (node, c) of the nodes in components so far; others stand alone
        own = lambda name, n: groups.select(F.col("node").alias(name), F.col("c").alias(n))  # noqa: E731, B023
        ends = joined(joined(level.where("into is not null"), own("onward", "c"), "onward", "left"), own("into", "d"), "into", "left")
        behind, ahead = F.coalesce("c", "onward"), F.coalesce("d", "into")
        joins = ends.where(behind == ahead).select("node", behind.alias("c"), "onward").distinct()
        groups = settle(groups.unionAll(joins.select("node", "c")).unionAll(joins.select(F.col("onward").alias("node"), "c")).distinct())
    groups = settle(groups)
    least = settle(groups.groupBy("c").agg(F.min("node").alias("component")))  # written, so that a component with most nodes can be split in the join
    named = joined(groups, least, "c").select("node", "component")
    return joined(nodes, named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cycle_boxes(edges: DataFrame, parent: DataFrame) -> DataFrame:
    """(container, box, node): siblings that are in a cycle with each other. parent: node, container."""
    a, b = parent.select(F.col("node").alias("src"), "container"), parent.select(F.col("node").alias("dst"), F.col("container").alias("other"))
    inside = edges.join(a, "src").join(b, "dst").where("container = other")
    groups = strong_components(inside.select("src", "dst"))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return groups.join(sizes, "component").join(parent, "node").select("container", F.col("component").alias("box"), "node")


class _Remains:
    """Items of one container that are in cycles or between them, with the items still before and behind each."""

    def __init__(self, pairs) -> None:
        self.ahead: dict[str, set] = {}
        self.behind: dict[str, set] = {}
        for a, b in pairs:
            for x in (a, b):
                self.ahead.setdefault(x, set())
                self.behind.setdefault(x, set())
            self.ahead[a].add(b)
            self.behind[b].add(a)
        self.pull = [(self._rank(x), x) for x in self.ahead]
        heapify(self.pull)

    def _rank(self, x: str) -> int:
        return len(self.behind[x]) - len(self.ahead[x])

    def without(self, x: str, ends: dict[str, set], others: dict[str, set]) -> list[str]:
        """Takes x out; the items that have nothing left in ends then. others: the opposite direction."""
        freed = []
        for y in others.pop(x):
            ends[y].discard(x)
            if not ends[y]:
                freed.append(y)
            heappush(self.pull, (self._rank(y), y))
        for y in ends.pop(x):
            others[y].discard(x)
            heappush(self.pull, (self._rank(y), y))
        return freed

    def cut(self) -> str:
        """The item with most ahead of it less behind it, the first by name of equals; ranks that have changed are passed over."""
        while True:
            rank, x = heappop(self.pull)
            if x in self.ahead and self._rank(x) == rank:
                return x

    def order(self) -> tuple[list[str], list[str]]:
        """(front, end backwards) of all items."""
        front, back = [], []
        ready = {True: [], False: []}  # items with nothing ahead, and with nothing behind, for the next pass
        while self.ahead:
            x = self.cut()
            front.append(x)
            self._release(x, ready)
            while ready[True] or ready[False]:
                for ending, line, ends, others in ((True, back, self.ahead, self.behind), (False, front, self.behind, self.ahead)):
                    now, ready[ending] = ready[ending], []
                    heapify(now)
                    while now:  # by name; what becomes free behind the pass's place waits for the next one
                        x = heappop(now)
                        if x not in ends or ends[x]:
                            continue
                        line.append(x)
                        lone = [y for y in ends[x] | others[x]]
                        for y in self.without(x, ends, others):
                            heappush(now, y) if y > x else ready[ending].append(y)
                        ready[not ending] += [y for y in lone if y in others and not others[y]]
        return front, back

    def _release(self, x: str, ready: dict[bool, list]) -> None:
        about = self.ahead[x] | self.behind[x]
        self.without(x, self.ahead, self.behind)
        ready[True] += [y for y in about if not self.ahead[y]]
        ready[False] += [y for y in about if not self.behind[y]]


def _remains(pdf: pd.DataFrame) -> pd.DataFrame:
    front, back = _Remains(zip(pdf["src"], pdf["dst"], strict=True)).order()
    return pd.DataFrame({"container": pdf["container"].iloc[0], "node": front + back, "side": [1] * len(front) + [2] * len(back), "turn": [*range(len(front)), *(-i for i in range(len(back)))]})


def acyclic_order(edges: DataFrame, container: str = "container") -> DataFrame:
    """(container, node, position): a topological order of each container's items, cycles cut greedily.

    Whole passes over the items by name put sinks at the end and then sources at the front, as long as any is left; with
    neither, the item with most outgoing less incoming wires comes next, the first by name of equals. Several wires
    between two items count as one.

    Which pass takes an item is a longest way: an item goes in the pass of the item that it waits for, or one later if
    that comes after it by name. So all that no cycle leads to, or that leads to none, is placed by carried() in rounds,
    whatever a container's size, and numbered by ranges; only what is in cycles or between them is one task's a
    container.
    """
    pairs = settle(edges.where("src is not null and dst is not null").select(F.col(container).alias("container"), "src", "dst").distinct())
    wires = settle(pairs.where("src <> dst"))
    nodes = settle(pairs.select("container", F.col("src").alias("node")).unionByName(pairs.select("container", F.col("dst").alias("node"))).distinct())
    item = lambda c: F.struct("container", F.col(c).alias("node"))
    named = nodes.select(item("node").alias("node"), F.lit(0).cast("long").alias("turn"))

    def passes(first: str, then: str) -> DataFrame:
        waits = wires.select(item(first).alias("src"), item(then).alias("dst"), F.when(F.col(first) > F.col(then), 1).otherwise(0).alias("w"))
        return carried(named, waits, {"turn": LONGEST}).select("node.*", "turn")

    ends, fronts = passes("dst", "src"), passes("src", "dst")
    met = settle(ends.withColumnRenamed("turn", "end").join(fronts.withColumnRenamed("turn", "front"), ["container", "node"], "full"))
    backwards = F.col("front").isNull() | F.coalesce(F.col("end") <= F.col("front"), F.lit(False))
    # side 0: front; 1, 2: what is left, to the front and to the end; 3: end, last passes first.
    placed = met.select("container", "node", F.when(backwards, 3).otherwise(0).alias("side"), F.when(backwards, -F.col("end")).otherwise(F.col("front")).alias("turn"), backwards.alias("back"))
    known = placed.select("container", "node")
    left = wires.join(known.withColumnRenamed("node", "src"), ["container", "src"], "left_anti").join(known.withColumnRenamed("node", "dst"), ["container", "dst"], "left_anti")
    rest = left.groupBy("container").applyInPandas(_remains, "container string, node string, side int, turn long")
    every = placed.unionByName(rest.withColumn("back", F.lit(False)))
    # Inside a pass names rise; the end is read backwards, so they fall there.
    placed = numbered(every, "container", "side", "turn", F.when(~F.col("back"), F.col("node")).asc_nulls_first(), F.when(F.col("back"), F.col("node")).desc_nulls_first())
    return placed.select(F.col("container").alias(container), "node", F.col("place").alias("position"))


def layer_order(layers: DataFrame, edges: DataFrame, sweeps: int = 4) -> DataFrame:
    """(node, layer, pos): places inside layers, by sweeps of barycentres down and up; ties keep their places, at first by name.

    layers: node, layer; edges: src, dst. A sweep is two joins and an average a node; the places of one layer are numbered
    by a window over that layer.
    """
    place = lambda df: df.select("node", "layer", (F.row_number().over(Window.partitionBy("layer").orderBy("at", "pos", "node")) - 1).alias("pos"))
    placed = settle(place(layers.select("node", "layer", F.lit(0.0).alias("at"), F.lit(0).alias("pos"))))
    pairs = settle(edges.where("src <> dst").select("src", "dst").distinct())
    for sweep in range(sweeps):
        own, other = ("dst", "src") if sweep % 2 == 0 else ("src", "dst")
        around = pairs.join(placed.select(F.col("node").alias(other), F.col("pos").alias("p")), other).groupBy(F.col(own).alias("node")).agg(F.avg("p").alias("mean"))
        following = settle(place(placed.join(around, "node", "left").withColumn("at", F.coalesce("mean", F.col("pos").cast("double")))))
        drop_settled(placed)
        placed = following
    return placed


def longest_layers(edges: DataFrame) -> DataFrame:
    """(node, layer) of an acyclic graph (src, dst): the longest way to a node.

    Chains and trees take rounds by the logarithm of their depth (see carried). A cycle is a ValueError. Null ends lead
    nowhere; the null node is of layer 0.
    """
    edges = settle(edges.select("src", "dst").distinct())
    nodes = settle(edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct().withColumn("layer", F.lit(0).cast("long")))
    found = carried(nodes, edges.withColumn("w", F.lit(1)), {"layer": LONGEST}).unionByName(nodes.where("node is null"))
    if found.count() < nodes.count():
        raise ValueError("the graph has a cycle")
    return found.select("node", F.col("layer").cast("int").alias("layer"))


def flow_layers(entries: DataFrame, links: DataFrame, layers: int = 12, steps: int = 400) -> DataFrame:
    """(flow, layer, pos, step): for each entry its senders and itself, then what it reaches, layer by layer.

    entries: flow, step; links: source, target, kind, tier. Only proven and possible links count; request links only
    lead to an entry. What the caps cut is counted by flow_truncated.
    """
    senders, onward = _senders(entries, links)
    reached = _first_layers(entries.select(F.col("flow").alias("root"), F.col("step").alias("node")), onward, layers - 1, steps)
    first = _firsts(senders, "flow", "step", steps).withColumnRenamed("flow", "_flow")  # flows with as many show nothing else
    met = reached.join(first.hint("merge"), F.col("root").eqNullSafe(F.col("_flow")), "left")
    own, none = F.coalesce("firsts", F.expr("slice(layers[0], 1, 0)")), F.array_compact("firsts")
    at = lambda layer: lambda step: F.struct(layer.cast("int").alias("layer"), step.alias("step"))
    beside = lambda steps: F.when(F.col("firsts").isNull(), steps).otherwise(F.array_except(steps, none))
    every = F.concat(F.transform(own, at(F.lit(0))), F.flatten(F.transform("layers", lambda own, i: F.transform(beside(own), at(i)))))
    placed = met.select(F.col("root").alias("flow"), F.posexplode(F.slice(every, 1, steps)).alias("pos", "at"))
    return placed.select("flow", "at.layer", "pos", "at.step").where(F.col("layer") < layers)


def flow_truncated(entries: DataFrame, links: DataFrame, layers: int = 12, steps: int = 400) -> DataFrame:
    """(flow, kept, truncated): how many steps of each flow the caps keep and cut.

    Kept are the first steps of the layers above the cut; how many there are in all is counted by components (see
    reach_sizes), so that flows which lead into the same cycles don't list what is in and behind them one by one.
    """
    senders, onward = _senders(entries, links)
    starts, senders = entries.select(F.col("flow").alias("root"), F.col("step").alias("node")), settle(senders)
    near = first_reached(starts, onward, layers - 1, steps).select(F.col("root").alias("flow"), F.col("node").alias("step"))
    kept = near.unionByName(senders).distinct().groupBy("flow").agg(F.least(F.count(F.lit(1)), F.lit(steps)).cast("long").alias("kept"))
    sizes = reach_sizes(starts, onward, senders.select(F.col("flow").alias("root"), F.col("step").alias("node")))
    return kept.join(sizes.withColumnRenamed("root", "flow"), "flow").select("flow", "kept", (F.col("n") - F.col("kept")).alias("truncated"))


def _senders(entries: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flow, step of what sends requests to its entries, the links on from step to step: src, dst)."""
    usable = links.where(F.col("tier").isin("Proven", "PossibleSet"))
    asked = usable.where("kind = 'Request'").select(F.col("target").alias("step"), "source").distinct()
    onward = usable.where("kind <> 'Request'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    senders = entries.join(asked, "step").select("flow", F.col("source").alias("step")).distinct()
    return senders.join(entries, ["flow", "step"], "left_anti"), onward


def first_reached(starts: DataFrame, edges: DataFrame, most: int | None, full: int) -> DataFrame:
    """(root, node, hop) of the first full nodes by (hop, node) that each start reaches along (src, dst), in at most most hops.

    starts: root, node.
    """
    layers = _first_layers(starts, edges, most, full).select("root", F.posexplode("layers").alias("hop", "nodes"))
    return layers.select("root", F.explode("nodes").alias("node"), "hop")


def _firsts(rows: DataFrame, key: str, value: str, full: int) -> DataFrame:
    """(key, firsts): the first full values of each key, in order, none first."""
    own = Window.partitionBy(key).orderBy(value)
    cut = rows.select(key, value).distinct().withColumn("place", F.row_number().over(own)).where(F.col("place") <= full)
    listed = F.sort_array(F.collect_list(F.struct(value)))  # of structs, as a list leaves nulls out
    return cut.groupBy(key).agg(F.transform(listed, lambda x: x[value]).alias("firsts"))


def _first_layers(starts: DataFrame, edges: DataFrame, most: int | None, full: int) -> DataFrame:
    """(root, layers): what first_reached gives, as a list of nodes for each hop.

    A root is one row, and what a node leads to is one list. A root that has all its nodes goes no further, and of a
    node only the first full ways on can matter, so no root meets more than full * full nodes in a hop, whatever it
    reaches. A root that needs few nodes more first asks for those up to a bound only, which its last nodes suggest; if
    too few are, it asks for all in the next round. The lists grow with the tables: none is broadcast.
    """
    ways = settle(_firsts(edges, "src", "dst", full))
    usual = ways.agg(F.avg(F.size("firsts"))).first()[0] or 1.0
    begun = _firsts(starts, "root", "node", full)
    state, out = settle(begun.select("root", F.array("firsts").alias("layers"), (F.size("firsts") < full).alias("going"), F.lit(False).alias("whole"))), None
    seen, last = F.flatten("layers"), F.element_at("layers", -1)
    needs = F.lit(full) - F.size(seen)
    enough = F.ceil(SLACK * needs / usual).cast("int") + 2  # so many of the last nodes lead on to what is needed, were all spread alike
    bound = F.when(~F.col("whole") & (enough < F.size(last)), F.get(last, enough))
    going = F.col("going") if most is None else F.col("going") & (F.size("layers") <= most)
    while not state.where(going).isEmpty():
        ended, live = state.where(~going), state.where(going).withColumn("bound", bound)
        out = ended if out is None else out.unionByName(ended)
        ahead = live.select(F.col("root").alias("_root"), "bound", F.explode(last).alias("node")).join(ways.hint("merge"), F.col("node") == F.col("src"))
        near = ahead.select("_root", F.filter("firsts", lambda x: F.coalesce(x <= F.col("bound"), F.lit(True))).alias("near")).where(F.size("near") > 0)
        onward = near.repartition("_root").groupBy("_root").agg(F.flatten(F.collect_list("near")).alias("onward"))
        met = live.join(onward.hint("merge"), F.col("root").eqNullSafe(F.col("_root")), "left")
        met = met.select("root", "layers", "bound", F.slice(F.sort_array(F.array_except("onward", seen)), F.lit(1), needs).alias("fresh"))
        n = F.coalesce(F.size("fresh"), F.lit(0))
        again = F.col("bound").isNotNull() & (n < needs)
        told = F.when(again | (n == 0), F.col("layers")).otherwise(F.concat("layers", F.array("fresh")))
        state = settle(met.select("root", told.alias("layers"), (again | ((n > 0) & (n < needs))).alias("going"), again.alias("whole")))
    return (state if out is None else out.unionByName(state)).select("root", "layers")


def reach_sizes(starts: DataFrame, edges: DataFrame, besides: DataFrame) -> DataFrame:
    """(root, n): how many nodes each root's starts (root, node) reach along (src, dst), themselves included, and of besides (root, node).

    Strongly connected components are condensed and weigh their nodes. What the largest one reaches is found once; roots
    that lead to it only list what else they reach, component by component.
    """
    edges = settle(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    of = settle(strong_components(edges))
    sizes = settle(of.groupBy("component").agg(F.count(F.lit(1)).alias("w")))
    named = lambda rows: rows.join(of, "node", "left").select("root", F.coalesce("component", "node").alias("node")).distinct()
    a, b = of.select(F.col("node").alias("src"), F.col("component").alias("a")), of.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    wires = settle(edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    hub = sizes.orderBy(F.desc("w"), "component").limit(1).select(F.lit(0).alias("root"), F.col("component").alias("node"))
    below = settle(reach(hub, wires, settled=True).select("node"))
    above = settle(reach(hub, wires.select(F.col("dst").alias("src"), F.col("src").alias("dst")), settled=True).select("node"))
    begins = settle(named(starts))
    touching = settle(begins.join(above, "node", "left_semi").select("root").distinct())
    # What lies below is left out of the ways of roots that reach it all; the others never come to what lies above.
    wide = reach(begins.join(touching, "root", "left_semi").join(below, "node", "left_anti"), settle(wires.join(below.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")), settled=True)
    narrow = reach(begins.join(touching, "root", "left_anti"), wires, settled=True)
    listed = settle(wide.select("root", "node").unionByName(narrow.select("root", "node")))
    weighed = lambda rows: rows.join(sizes.withColumnRenamed("component", "node"), "node", "left").select(*rows.columns, F.coalesce("w", F.lit(1)).alias("w"))
    whole = weighed(below).agg(F.sum("w").alias("w"))
    shared = touching.crossJoin(whole).select("root", "w")
    more = besides.distinct().join(of, "node", "left").select("root", F.coalesce("component", "node").alias("node"))
    more = settle(more.join(listed, ["root", "node"], "left_anti"))
    inside = more.join(touching, "root", "left_semi").join(below, "node", "left_semi").groupBy("root").agg((-F.count(F.lit(1))).alias("w"))
    parts = weighed(listed).select("root", "w").unionByName(shared).unionByName(more.select("root", F.lit(1).alias("w"))).unionByName(inside)
    return parts.groupBy("root").agg(F.sum("w").alias("n"))


def descendants(folders: DataFrame, of: str) -> DataFrame:
    """Folders below a folder, by path prefix."""
    return folders.where(F.col("path").startswith(of + "/") if of else F.col("path") != "")


def hidden(paths: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Paths with a collapsed folder above them, by their exploded ancestors. paths: path; collapsed: path."""
    from graphweft.functions.paths import ancestors

    above = paths.select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    return above.join(collapsed.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()


def lifted(pairs: DataFrame) -> DataFrame:
    """(container, provider, consumer): a wire's pieces inside each container below the lowest common one.

    pairs: provider, consumer paths. Inside the common container the piece runs between its two children; deeper, it
    runs to or from the container's gate, written '^'.
    """
    from graphweft.functions.paths import ancestors, parts

    a, b = F.array_append(ancestors(F.col("provider")), F.col("provider")), F.array_append(ancestors(F.col("consumer")), F.col("consumer"))
    met = pairs.where("provider <> consumer").select("provider", "consumer", a.alias("a"), b.alias("b"))
    same = met.withColumn("n", F.size(F.array_intersect("a", "b")))
    piece = lambda c, p, q: F.struct(c.alias("container"), p.alias("from_item"), q.alias("to_item"))
    common = F.array(piece(F.get("a", F.col("n") - 1), F.get("a", F.col("n")), F.get("b", F.col("n"))))
    gate = F.lit("^")
    up = F.transform(F.sequence(F.col("n"), F.size("a") - 2, F.lit(1)), lambda i: piece(F.get("a", i), F.get("a", i + 1), gate))
    down = F.transform(F.sequence(F.col("n"), F.size("b") - 2, F.lit(1)), lambda i: piece(F.get("b", i), gate, F.get("b", i + 1)))
    none = F.filter(common, lambda x: F.lit(False))
    every = F.concat(common, F.when(F.size("a") - 2 >= F.col("n"), up).otherwise(none), F.when(F.size("b") - 2 >= F.col("n"), down).otherwise(none))
    del parts
    return same.select(F.inline(every)).distinct()


def gates(pairs: DataFrame) -> DataFrame:
    """(folder, provider): from where wires come into each top folder. pairs: provider, consumer paths."""
    top = lambda c: F.substring_index(c, "/", 1)
    return pairs.where(top("provider") != top("consumer")).select(top("consumer").alias("folder"), "provider").distinct()


def lowest_common(a: str, b: str):
    """The deepest folder above both paths, as a column."""
    from graphweft.functions.paths import ancestors

    shared = F.array_intersect(ancestors(F.col(a)), ancestors(F.col(b)))
    return F.element_at(shared, -1)
