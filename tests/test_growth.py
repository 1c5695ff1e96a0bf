"""Work that grows no faster than the tables: what is sent, written and called, and the same results."""

import random

import pytest

from graphweft.operators import graph, search
from graphweft.streaming import logs


def plain_firsts(starts, edges, most, full):
    ahead, out = {}, set()
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    for root in {r for r, _ in starts}:
        now, hop, kept = {n for r, n in starts if r == root}, 0, []
        seen = set(now)
        while now and len(kept) < full and (most is None or hop <= most):
            kept += [(root, n, hop) for n in sorted(now)]
            now, hop = {b for a in now for b in ahead.get(a, ()) if b not in seen}, hop + 1
            seen |= now
        out |= set(kept[:full])
    return out


@pytest.mark.parametrize(("even", "slack"), [(True, 3), (False, 3), (True, 0)])
def test_first_steps_are_a_row_a_flow(spark, monkeypatch, even, slack):
    """Nodes that lead on evenly, and nodes that lead to late names or bounds that leave too few: a written row is a root or a node."""
    monkeypatch.setattr(graph, "SLACK", slack, raising=False)
    written, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: written.append(settle(df)) or written[-1])
    rnd = random.Random(5)
    name = lambda low: f"n{rnd.randrange(low, 500):03}"
    edges = [(name(0), name(0 if even else i % 450)) for i in range(2500)] + [("n001", "n001"), ("n002", "a")]
    starts = [(f"r{i % 60}", name(0)) for i in range(70)] + [("r0", "nowhere")]
    e, s = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(starts, "root string, node string")
    for most, full in ((None, 60), (3, 40), (2, 5), (0, 3)):
        written.clear()
        got = [tuple(r) for r in graph.first_reached(s, e, most, full).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_firsts(starts, edges, most, full)
        assert max(t.count() for t in written) <= 500


def test_open_calls_are_a_share_of_a_batch(spark, tmp_path, monkeypatch):
    """Many calls over three batches are few Python calls, and each is answered as by the first of its calls and results."""
    monkeypatch.setattr(logs, "SHARES", 3)
    rnd = random.Random(9)
    batches = [[(rnd.choice(["a", "b", None]), f"c{rnd.randrange(60)}", rnd.choice(["edit", "plan"]), b * 1000 + i, rnd.random() < 0.6, rnd.random() < 0.4) for i in rnd.sample(range(1000), 80)] for b in range(3)]
    open_calls, want = {}, []
    for rows in batches:
        results = {}
        known = set(open_calls)
        for log, call, kind, at, is_call, bad in sorted(rows, key=lambda r: r[3]):
            if is_call:
                open_calls.setdefault((log, call), (kind, at)) if (log, call) not in known else None
            else:
                results.setdefault((log, call), bad)
        for one in set(results) & set(open_calls):
            kind, at = open_calls.pop(one)
            if not results[one] or kind == "plan":
                want.append((*one, kind, at, results[one]))
    called, schema = [], "log string, call_id string, kind string, at long, is_call boolean, is_error boolean"
    (tmp_path / "in").mkdir()
    stream = logs.pending_calls(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        run = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        called += [o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]]
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect()), key=repr) == sorted(want, key=repr)
    assert len(want) > 20 and max(called) <= 3


def test_an_index_of_long_texts(spark):
    """A text of many characters is read once, not a pair at a time; a word that lies in two batches is whole."""
    rnd = random.Random(4)
    rows = [("Symbol", "".join(rnd.choice("abc1_é") for _ in range(n)), "", "z" * n + "y", 1, i) for i, n in enumerate([50_000, 0, 3, 1, 2] * 30)]
    schema = "kind string, name string, detail string, path string, line int, key long"
    held, index = search.pair_index(spark.createDataFrame(rows, schema))
    got = {}
    for r in index.collect():
        for i in range(64):
            if r["bits"] >> i & 1:
                got.setdefault((r["field"], r["word"] * 64 + i), set()).add(r["pair"])
    for r in held.select("id", "name", "path").collect():
        for field, text in ((0, r["name"]), (1, r["path"])):
            known = [c for c in text if c in search.MASK_CHARS]
            first, last = {c: i for i, c in reversed(list(enumerate(known)))}, {c: i for i, c in enumerate(known)}
            assert got.pop((field, r["id"]), set()) == {a + b for a in first for b in last if first[a] < last[b]}
    assert not got
    for query in ("a1", "zy", "yz", "cab"):
        want = sum(_within(query, name) or _within(query, path) for _, name, _, path, _, _ in rows)
        assert search.matches(search.candidates(held, index, query), query).count() == want


def _within(query, text):
    at = iter(text)
    return all(c in at for c in query)


def test_components_broadcast_no_table(spark, monkeypatch):
    """Cycles, chains and lone nodes in rounds and in one task: joins of tables that grow with the edges shuffle both sides."""
    plans, settle = [], graph.settle

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    monkeypatch.setattr(graph, "settle", watched)
    edges = [(i, (i * 7 + i % 5) % 300) for i in range(300)] + [(i, i + 1) for i in range(400, 450)]
    df, components = spark.createDataFrame(edges, "src long, dst long"), []
    for few in (0, 1 << 16):
        monkeypatch.setattr(graph, "FEW", few)
        found = graph.strong_components(df)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        components.append(sorted(map(tuple, found.collect())))
    assert components[0] == components[1]
    assert not [p for p in plans if "BroadcastHashJoin" in p]
