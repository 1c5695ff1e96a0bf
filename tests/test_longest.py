"""Values carried along edges, the reachability index and orders built on them."""

import random

import pytest

from graphweft.operators import graph, longest, order, reachability, spread
from test_graph import plain_order


def plain(edges, values):
    ahead, into, own = {}, {}, {v: list(x) for v, x in values.items()}
    for a, b, w in edges:
        ahead.setdefault(a, []).append((b, w))
        into[b] = into.get(b, 0) + 1
    todo, out = [v for v in own if not into.get(v)], {}
    while todo:
        v = todo.pop()
        out[v] = tuple(own[v])
        for b, w in ahead.get(v, []):
            x, y = own[b], own[v]
            x[0], x[1], x[2] = max(x[0], y[0] + w), max(x[1], y[1]), x[2] | y[2]
            into[b] -= 1
            if not into[b]:
                todo.append(b)
    return out


def carried(spark, edges):
    values = {v: (0, v * 7919 % 101, 1 << (v % 60)) for e in edges for v in e[:2]}
    nodes = spark.createDataFrame([(v, *x) for v, x in values.items()] + [(None, 1, 1, 1)], "node long, a long, b long, c long")
    rows = spark.createDataFrame(edges + [(None, edges[0][1], 9), (edges[0][0], None, 9)], "src long, dst long, w long")
    got = longest.carried(nodes, rows, {"a": longest.LONGEST, "b": longest.GREATEST, "c": longest.MARKS})
    return {r["node"]: (r["a"], r["b"], r["c"]) for r in got.collect()}, plain(edges, values)


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_carried_values(spark, monkeypatch, few):
    monkeypatch.setattr(longest, "FEW", few)
    monkeypatch.setattr(spread, "KEY_ROWS", 3 if few else 1 << 20)
    rnd = random.Random(1)
    for k in range(2 if not few else 6):
        n = 24
        edges = [(rnd.randrange(n), rnd.randrange(n), rnd.randrange(3)) for _ in range(18 + 10 * k)]
        edges = [(min(a, b), max(a, b), w) if k % 2 else (a, b, w) for a, b, w in edges if a != b]
        got, want = carried(spark, edges)
        assert got == want


def test_rounds_of_a_long_chain(spark, monkeypatch):
    """10,000 nodes in a row: doubling, not a round a node; the same with one in ten ways beside it."""
    monkeypatch.setattr(longest, "FEW", 0)
    rounds, own = [0], longest.join_spread
    monkeypatch.setattr(longest, "join_spread", lambda *a: (rounds.__setitem__(0, rounds[0] + 1), own(*a))[1])
    chain = [(i, i + 1, 1) for i in range(10_000)]
    got, want = carried(spark, chain)
    assert got == want and rounds[0] < 20


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(spread, "KEY_ROWS", 10)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "i long, k string")
    table = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v long")
    for how in ("left", "inner"):
        got = sorted(map(tuple, spread.join_spread(rows, table, "k", how).select("i", "k", "v").collect()), key=repr)
        assert got == sorted(map(tuple, rows.join(table, "k", how).select("i", "k", "v").collect()), key=repr)


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_acyclic_order_at_any_size(spark, monkeypatch, few):
    """A container whose items are in chains, cycles and between cycles, by rounds and in one task."""
    monkeypatch.setattr(longest, "FEW", few)
    rng, rows, want = random.Random(9), [], {}
    for g in range(3):
        names = [f"n{i:02}" for i in range(40)]
        rng.shuffle(names)
        edges = [(names[i], names[i + 1]) for i in range(15)] + [(names[20], names[21]), (names[21], names[20]), (names[25], names[26]), (names[26], names[27]), (names[27], names[25]), (names[21], names[30]), (names[30], names[25])]
        edges += [(names[a], names[b]) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(12))]
        rows += [(str(g), a, b) for a, b in edges]
        want[str(g)] = plain_order(edges)
    got = {}
    for r in sorted(graph.acyclic_order(spark.createDataFrame(rows, "container string, src string, dst string")).collect(), key=lambda r: r["position"]):
        got.setdefault(r["container"], []).append(r["node"])
    assert got == want


def test_remains_of_cycles_alone():
    rnd = random.Random(3)
    for _ in range(2000):
        names = [f"n{i}" for i in range(rnd.randrange(2, 12))]
        edges = {(a, b) for a, b in ((rnd.choice(names), rnd.choice(names)) for _ in range(rnd.randrange(1, 4 * len(names)))) if a != b}
        while True:  # neither sinks nor sources
            inner = {a for a, _ in edges} & {b for _, b in edges}
            kept = {(a, b) for a, b in edges if a in inner and b in inner}
            if kept == edges:
                break
            edges = kept
        if edges:
            front, back = graph._Remains(sorted(edges)).order()
            assert front + back[::-1] == plain_order(list(edges))


def test_numbered_by_ranges(spark):
    rows = spark.createDataFrame([("hot" if i % 4 else f"g{i % 16}", i * 7919 % 1000) for i in range(1000)] + [(None, 5), (None, 3)], "g string, v long")
    got = {}
    for g, v, place in order.numbered(rows, "g", "v").collect():
        got.setdefault(g, []).append((place, v))
    for g, found in got.items():
        assert [p for p, _ in sorted(found)] == list(range(len(found))) and [v for _, v in sorted(found)] == sorted(v for _, v in found), g


def test_reachability(spark):
    rnd, n = random.Random(1), 60
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(30)] + [(100 + i, 107 + i) for i in range(0, 20, 3)]
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            new = ahead.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    pairs = [(rnd.randrange(n + 5), rnd.randrange(n + 5)) for _ in range(400)] + [(rnd.randrange(100, 131), rnd.randrange(100, 131)) for _ in range(200)] + [(None, 1), (1, None), (5, 5), (5, 5)]
    index = reachability.reach_index(spark.createDataFrame([*edges, (None, 3), (3, None)], "src long, dst long"))
    got = reachability.trace_pairs(spark.createDataFrame(pairs, "a long, b long"), index).collect()
    assert len(got) == len({p for p in pairs if None not in p})
    assert {(r["a"], r["b"]): r["reaches"] for r in got} == {(a, b): b in reach(a) for a, b in pairs if None not in (a, b)}
    assert sum(not r["walked"] for r in got) > 0.8 * len(got)  # most are decided by labels
    none = spark.createDataFrame([], "src long, dst long")
    assert [tuple(r) for r in reachability.trace_pairs(spark.createDataFrame([(1, 1), (1, 2)], "a long, b long"), reachability.reach_index(none)).orderBy("b").collect()] == [(1, 1, True, False), (1, 2, False, False)]
