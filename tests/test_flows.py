"""Flows by components and by their first steps, against plain walks."""

import random

from graphweft.operators import graph


def plain_flows(entries, links, layers, steps):
    usable = {(s, t, k) for s, t, k, tier in links if tier in ("Proven", "PossibleSet")}
    placed, counts = set(), {}
    for flow in {f for f, _ in entries}:
        own = {s for f, s in entries if f == flow}
        senders = {s for s, t, k in usable if k == "Request" and t in own} - own
        hops, now, hop = dict.fromkeys(own, 0), own, 0
        while now:
            hop += 1
            now = {t for s, t, k in usable if k != "Request" and s in now} - set(hops)
            hops |= dict.fromkeys(now, hop)
        rows = sorted([(0, False, s) for s in senders] + [(h, h == 0, s) for s, h in hops.items() if s not in senders])
        kept = [(flow, layer, i, s) for i, (layer, _, s) in enumerate(rows) if layer < layers and i < steps]
        placed |= set(kept)
        counts[flow] = (len(kept), len(rows) - len(kept))
    return placed, counts


def tables(spark, entries, links):
    return spark.createDataFrame(entries, "flow string, step string"), spark.createDataFrame(links, "source string, target string, kind string, tier string")


def test_flows_are_those_of_plain_walks(spark):
    """Graphs with one large cycle, with several small ones, and without any; flows with one entry and with two."""
    for seed, n, ways, layers, steps in ((1, 25, 2.5, 2, 5), (2, 30, 1.2, 12, 400)):
        rnd = random.Random(seed)
        name = lambda rnd=rnd, n=n: f"s{rnd.randrange(n)}"
        links = [(name(), name(), rnd.choice(["Call", "Call", "Call", "Request"]), rnd.choice(["Proven", "PossibleSet", "Proven", "Unresolved"])) for _ in range(int(n * ways * 1.5))]
        entries = sorted({(f"f{i % 12}", name()) for i in range(16)})
        placed, counts = plain_flows(entries, links, layers, steps)
        e, table = tables(spark, entries, links)
        assert {(r["flow"], r["layer"], r["pos"], r["step"]) for r in graph.flow_layers(e, table, layers, steps).collect()} == placed
        assert {r["flow"]: (r["kept"], r["truncated"]) for r in graph.flow_truncated(e, table, layers, steps).collect()} == counts


def test_flows_into_one_cycle_are_not_listed_step_by_step(spark, monkeypatch):
    """80 flows that reach 80 steps each, and 30 that have more ways on than they may keep: no written table has a row for each."""
    written, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: written.append(settle(df)) or written[-1])
    n = 80
    ring = [(f"s{i}", f"s{(i + 1) % n}", "Call", "Proven") for i in range(n)] + [(f"s{i}", f"s{(i * 7) % n}", "Call", "Proven") for i in range(n)]
    e, links = tables(spark, [(f"s{i}", f"s{i}") for i in range(n)], ring)
    assert {(r["kept"], r["truncated"]) for r in graph.flow_truncated(e, links, 2, 2).collect()} == {(2, n - 2)}
    assert max(t.count() for t in written) <= 4 * n
    written.clear()
    wide = [(f"a{i}", f"b{j}", "Call", "Proven") for i in range(30) for j in range(40)]
    e, links = tables(spark, [(f"a{i}", f"a{i}") for i in range(30)], wide)
    assert graph.flow_layers(e, links, 12, 5).count() == 150
    assert max(t.count() for t in written) <= 30 * 5
