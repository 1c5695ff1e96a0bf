"""Graph loops beyond what the queries' inputs reach."""

import math
import random

import pytest

from graphweft.operators import graph, order, spatial
from graphweft.sources import stores


def test_layers_of_a_long_chain_and_of_a_cycle(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(70)] + [("n0", "n69"), ("n3", "end"), (None, "n0")]
    got = {r["node"]: r["layer"] for r in graph.longest_layers(spark.createDataFrame(chain, "src string, dst string")).collect()}
    assert got == {**{f"n{i}": i for i in range(71)}, "end": 4, None: 0}
    with pytest.raises(ValueError):
        graph.longest_layers(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string"))
    assert graph.longest_layers(spark.createDataFrame([], "src string, dst string")).collect() == []


def plain_order(edges):
    """Passes of sinks, then of sources, over names in order; then the greatest surplus of ways out, the first of equals."""
    names = sorted({x for e in edges for x in e})
    left, edges, front, back = set(names), {e for e in edges if e[0] != e[1]}, [], []
    while left:
        moved = True
        while moved:
            moved = False
            for side, line in ((0, back), (1, front)):
                for x in names:
                    if x in left and not any(e[side] == x and e[1 - side] in left for e in edges):
                        left.remove(x)
                        line.append(x)
                        moved = True
        if left:
            surplus = {x: sum(e[0] == x and e[1] in left for e in edges) - sum(e[1] == x and e[0] in left for e in edges) for x in left}
            x = min(left, key=lambda y: (-surplus[y], y))
            left.remove(x)
            front.append(x)
    return front + back[::-1]


def test_acyclic_order_is_the_plain_one(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g in range(120):
        n = rng.randint(2, 9)
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randint(1, 2 * n))]
        rows += [(str(g), a, b) for a, b in edges]
        want[str(g)] = plain_order(edges)
    got = {}
    for r in sorted(graph.acyclic_order(spark.createDataFrame(rows, "container string, src string, dst string")).collect(), key=lambda r: r["position"]):
        got.setdefault(r["container"], []).append(r["node"])
    assert got == want


def test_components_of_cycles_chains_and_random_graphs(spark):
    rng = random.Random(2)
    ring = [(i, (i + 1) % 60) for i in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 100), (130, 131), (131, 129)]
    for edges in (ring, [(rng.randrange(25), rng.randrange(25)) for _ in range(60)], [(1, 1)], [(1, 2), (2, 1)]):
        ahead = {}
        for a, b in edges:
            ahead.setdefault(a, set()).add(b)
        reach = {}
        for x in {x for e in edges for x in e}:
            seen, todo = {x}, [x]
            while todo:
                new = ahead.get(todo.pop(), set()) - seen
                seen |= new
                todo += new
            reach[x] = seen
        want = {x: min(y for y in reach[x] if x in reach[y]) for x in reach}
        got = graph.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()
        assert sorted((r["node"], r["component"]) for r in got) == sorted(want.items())
    assert graph.strong_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_full_roots_go_no_further(spark):
    edges = spark.createDataFrame([(i, 10 * i + k) for i in range(1, 40) for k in range(3)], "src long, dst long")
    starts = spark.createDataFrame([(1, 1), (2, 39)], "root long, node long")
    every, some = graph.reach(starts, edges).collect(), graph.reach(starts, edges, full=4).collect()
    assert set(map(tuple, some)) < set(map(tuple, every)) and sum(r["root"] == 1 for r in some) >= 4


def test_places_in_layers_follow_barycentres(spark):
    layers = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("x", 1), ("y", 1), ("z", 1)], "node string, layer int")
    edges = spark.createDataFrame([("a", "z"), ("b", "y"), ("c", "x")], "src string, dst string")
    got = {r["node"]: r["pos"] for r in graph.layer_order(layers, edges).collect()}
    assert [got[n] for n in "abc"] == [0, 1, 2] and [got[n] for n in "zyx"] == [0, 1, 2]


def plain_columns(sizes):
    best = None
    total = sum(h + 18 for _, h in sizes)
    for k in range(1, len(sizes) + 1):
        columns, held = [[]], 0.0
        for i, (w, h) in enumerate(sizes):
            if held > 0 and held + h + 18 > total / k + 0.5:
                columns.append([])
                held = 0.0
            columns[-1].append(i)
            held += h + 18
        tall = max(sum(sizes[i][1] + 18 for i in c) for c in columns)
        wide = sum(max(sizes[i][0] for i in c) for c in columns) + 48 * (len(columns) - 1)
        score = abs(math.log(wide / max(tall, 1) / 1.6))
        if best is None or score < best[0] - 1e-4:
            best = (score, [n for n, c in enumerate(columns) for _ in c])
        if len(columns) < k:
            break
    return best[1]


def test_column_packing_is_the_plain_one(spark):
    rng = random.Random(3)
    groups = {str(g): [(rng.choice([20.0, 90.0, rng.uniform(1, 300)]), rng.choice([10.0, 10.0, rng.uniform(1, 400)])) for _ in range(rng.randint(1, 40))] for g in range(60)}
    rows = [(g, i, w, h) for g, own in groups.items() for i, (w, h) in enumerate(own)]
    got = {}
    for r in sorted(spatial.packed_columns(spark.createDataFrame(rows, "grp string, idx long, width double, height double")).collect(), key=lambda r: r["idx"]):
        got.setdefault(r["grp"], []).append(r["col"])
    assert got == {g: plain_columns(own) for g, own in groups.items()}


def test_treemap_fills_the_square_row_by_row(spark):
    """Areas by share, no overlap, and rows that are squarest: no row would have been better one item shorter or longer."""
    rng = random.Random(4)
    groups = {str(g): [rng.choice([1.0, 5.0, rng.uniform(0.1, 60)]) for _ in range(rng.randint(1, 25))] for g in range(30)}
    rows = [(g, i, s) for g, own in groups.items() for i, s in enumerate(own)]
    got = {}
    for r in sorted(spatial.treemap(spark.createDataFrame(rows, "grp string, idx long, size double")).collect(), key=lambda r: r["idx"]):
        got.setdefault(r["grp"], []).append((r["x0"], r["y0"], r["x1"], r["y1"]))
    for g, own in groups.items():
        total, at, left = sum(own), 0, [0.0, 0.0, 1.0, 1.0]
        for (x0, y0, x1, y1), s in zip(got[g], own, strict=True):
            assert abs((x1 - x0) * (y1 - y0) - s / total) < 1e-9
        while at < len(own):  # a plain version, one row at a time
            w, h = left[2] - left[0], left[3] - left[1]
            short, worst = min(w, h), None
            n = 0
            while at + n < len(own):
                areas = [x / total for x in own[at : at + n + 1]]
                thick = sum(areas) / short
                ratio = max(max(thick * thick / a, a / (thick * thick)) for a in areas)
                if worst is not None and ratio > worst:
                    break
                worst, n = ratio, n + 1
            thick, along = sum(own[at : at + n]) / total / short, left[1] if w >= h else left[0]
            for k in range(at, at + n):
                step = own[k] / total / thick
                want = (left[0], along, left[0] + thick, along + step) if w >= h else (along, left[1], along + step, left[1] + thick)
                assert max(abs(a - b) for a, b in zip(got[g][k], want, strict=True)) < 1e-7
                along += step
            left = [left[0] + thick, left[1], left[2], left[3]] if w >= h else [left[0], left[1] + thick, left[2], left[3]]
            at += n


def test_running_sums_over_ranges(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(50), rng.randrange(9)) for i in range(500)]
    got = order.running(spark.createDataFrame(rows, "id long, a long, b long"), "a", "id", sums=("b",)).collect()
    at = sums = 0
    by = {r["id"]: (r["before"], r["before_b"]) for r in got}
    for i, a, b in sorted(rows, key=lambda r: (r[1], r[0])):
        assert by[i] == (at, sums)
        at, sums = at + 1, sums + b
    assert order.running(spark.createDataFrame([], "a long"), "a").collect() == []


def test_rectangles_of_all_sizes_meet(spark):
    rng = random.Random(6)

    def rect():
        x, y, w, h = rng.uniform(-500, 500), rng.uniform(-500, 500), rng.choice([0, 3, 90, 4000, 1e6]), rng.choice([0, 5, 200, 9000])
        return x, y, x + w, y + h

    rects, queries = [(i, *rect()) for i in range(120)], [(i, *rect()) for i in range(60)]
    points = [(i, rng.uniform(-600, 600), rng.uniform(-600, 600)) for i in range(100)]
    r = spark.createDataFrame(rects, "id long, x0 double, y0 double, x1 double, y1 double")
    got = [tuple(x) for x in spatial.query_rects(r, spark.createDataFrame(queries, "query long, x0 double, y0 double, x1 double, y1 double"), 16.0).collect()]
    want = [(q, i) for q, a0, b0, a1, b1 in queries for i, x0, y0, x1, y1 in rects if x0 <= a1 and a0 <= x1 and y0 <= b1 and b0 <= y1]
    assert sorted(got) == sorted(want)
    inside = [tuple(x) for x in spatial.query_points(r, spark.createDataFrame(points, "point long, x double, y double"), 16.0).collect()]
    assert sorted(inside) == sorted((p, i) for p, x, y in points for i, x0, y0, x1, y1 in rects if x0 <= x <= x1 and y0 <= y <= y1)


def test_a_saved_table_is_replaced_whole(spark, tmp_path):
    for n in (3, 5, 2):
        stores.save(spark.range(n), f"file://{tmp_path}", "t", 1, 7)
        assert stores.load(spark, f"file://{tmp_path}", "t", 1, 7).count() == n
    held = list((tmp_path / "name=t/version=1/key=7").iterdir())
    assert len(held) == 2
    newest = max(held, key=lambda p: (p / "_SUCCESS").stat().st_mtime)
    (newest / "_SUCCESS").unlink()  # a write that didn't end
    assert stores.load(spark, f"file://{tmp_path}", "t", 1, 7).count() == 5 and stores.load(spark, f"file://{tmp_path}", "t", 2, 7) is None
