"""Jobs, graph mutation, touches of patches, long imports and deep tools."""

import random
import threading
import time

from graphweft.operators import edges, extract, resolve, sessions
from graphweft.sources import git, tools
from graphweft.streaming import jobs


def test_jobs_start_in_order_and_tell_parts(spark):
    hub = jobs.Jobs(spark)
    hub.add("packages", lambda emit, results: spark.range(3).count())
    hub.add("broken", lambda emit, results: 1 / 0)
    hub.add("tools", lambda emit, results: results["packages"] + 1, after=("packages",))
    hub.add("any", lambda emit, results: results["broken"], once=("broken",))
    hub.add("never", lambda emit, results: 1, after=("broken",))
    hub.add("graph", jobs.progressive(("skeleton", lambda made: spark.range(4)), ("whole", lambda made: made["skeleton"].selectExpr("id * 2 id")), ("totals", lambda made: made["whole"].selectExpr("sum(id) n"))), after=("tools",))
    states = hub.wait(60)
    assert states == {"packages": "done", "broken": "failed", "tools": "done", "any": "done", "never": "cancelled", "graph": "done"}
    assert hub.results["tools"] == 4 and hub.results["graph"]["totals"].first()["n"] == 12
    events = hub.drain()
    at = {(e.job, e.kind): i for i, e in enumerate(events)}
    assert at["packages", "done"] < at["tools", "started"] < at["tools", "done"] < at["graph", "started"]
    assert [e.value[0] for e in events if e.kind == "part"] == ["skeleton", "whole", "totals"] and hub.drain() == []


def test_cancelled_jobs_stop(spark):
    ended, hub = threading.Event(), None
    hub = jobs.Jobs(spark, on_cancel=ended.set)
    slow = spark.udf.register("slow_number", lambda x: (time.sleep(0.2), x)[1], "long")
    hub.add("long", lambda emit, results: spark.range(4000).select(slow("id")).write.format("noop").mode("overwrite").save())
    hub.add("phases", lambda emit, results: [(emit("p", i), time.sleep(0.05)) for i in range(10_000)])
    hub.add("after", lambda emit, results: 1, after=("long",))
    hub.add("fine", lambda emit, results: 5)
    time.sleep(1.5)
    began = time.time()
    hub.cancel()
    states = hub.wait(60)
    assert states == {"long": "cancelled", "phases": "cancelled", "after": "cancelled", "fine": "done"} and ended.is_set()
    assert time.time() - began < 30


def wires(spark, rows):
    return spark.createDataFrame([(*r, "Proven", "R1") for r in rows], "out_node string, out_port int, in_node string, in_port int, tier string, basis string")


def test_a_graph_is_changed(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2)], "node string, x int")
    more = edges.add_nodes(nodes, spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "node string, x int"))
    assert sorted(map(tuple, more.collect())) == [("a", 1), ("b", 2), ("c", 3)]
    ports = spark.createDataFrame([(n, p, d, "Any") for n in "abc" for p, d in ((0, "in"), (1, "out"), (2, "in"))], "node string, port int, direction string, data_type string")
    asked = spark.createDataFrame([(1, "a", 1, "b", 0), (2, "b", 0, "a", 1), (3, "a", 1, "c", 0), (4, "c", 0, "c", 1), (5, "a", 1, "b", 9), (6, "c", 1, "b", 0)], "id int, node_a string, port_a int, node_b string, port_b int")
    held = edges.connect(wires(spark, [("a", 1, "c", 0)]), asked, ports)
    assert sorted(map(tuple, held.collect())) == [("a", 1, "b", 0, "Unresolved", "Manual"), ("a", 1, "c", 0, "Proven", "R1"), ("c", 1, "b", 0, "Unresolved", "Manual")]
    told = edges.set_provenance(held, wires(spark, [("c", 1, "b", 0), ("x", 1, "y", 0)]))
    assert {(r["out_node"], r["tier"]) for r in told.where("in_node = 'b'").collect()} == {("a", "Unresolved"), ("c", "Proven")}
    left = edges.disconnect(held, spark.createDataFrame([("b", 0)], "in_node string, in_port int"))
    assert [r["in_node"] for r in left.collect()] == ["c"]
    assert edges.disconnect_ports(held, spark.createDataFrame([("a", 1)], "node string, port int")).count() == 1


def test_new_files_meet_old_and_new_names(spark):
    names = spark.createDataFrame([("module", "m", "f1", 1), ("symbol", "s", "f2", 2)], "source string, key string, node string, scan_order long")
    new = spark.createDataFrame([("module", "n", "f9", 9)], "source string, key string, node string, scan_order long")
    refs = spark.createDataFrame([("f9", "m", "Import", False), ("f9", "n", "Import", True), ("f8", "n", "Call", True), ("f8", "none", "Call", True)], "consumer string, target string, kind string, proven boolean")
    got = {(r["provider"], r["consumer"], r["kind"], r["tier"]) for r in edges.materialised(names, new, refs).collect()}
    assert got == {("f1", "f9", "Import", "Unresolved"), ("f9", "f8", "Call", "Proven")}


def test_touches_of_patches_and_of_every_place(spark):
    text = "one\r\ntwo\ntwo\nthree\nfour\n"
    line = lambda s: [(c == "+", x) for c, x in (p.split(":") for p in s.split())]
    rows = [
        (1, "f", ["x"], None, [(2, line("=:two +:two =:three"))], None, "lit", 1),
        (2, "f", [], None, [(9, line("=:no +:three +:four"))], None, "lit", 1),
        (3, "f", [], None, [(9, line("=:no +:two"))], None, "candidates", 2),
        (4, "f", [], None, [(9, line("=:no =:yes"))], None, "stale", 0),
        (5, "f", [], None, [(3, [])], None, "lit", 1),
        (6, "f", ["two"], [True], None, None, "lit", 2),
        (7, "f", ["two", "one\r\ntwo"], [False, False], None, None, "candidates", 3),
        (8, "f", ["gone"], [True], None, None, "stale", 0),
        (9, "f", ["one"], None, None, True, "stale", 1),
        (10, "g", ["one"], None, None, None, "stale", 0),
    ]
    schema = "touch int, path string, parts array<string>, every array<boolean>, hunks array<struct<start:int,lines:array<struct<added:boolean,text:string>>>>, deleted boolean"
    got = {r["touch"]: (r["state"], r["count"]) for r in sessions.match_touch(spark.createDataFrame([r[:6] for r in rows], schema), spark.createDataFrame([("f", text)], "path string, text string")).collect()}
    assert got == {r[0]: r[6:] for r in rows}


def test_imports_lead_on_over_many_modules_and_end_in_cycles(spark):
    n = 3
    modules = spark.createDataFrame([(f"m{i}", None, "k", "m0") for i in range(n + 2)], "module string, parent string, crate string, root string")
    names = spark.createDataFrame([(f"m{i}", f"m{j}", f"m{j}", True, True) for i in range(n + 2) for j in range(n + 2)] + [(f"m{n}", "item", "ITEM", False, True)], "module string, name string, target string, is_module boolean, public boolean")
    imports = [(f"m{i}", "item", ["crate", f"m{i + 1}", "item"], True) for i in range(n)]
    imports += [("m0", "round", ["crate", "m1", "round"], True), ("m1", "round", ["crate", "m0", "round"], True)]
    paths = spark.createDataFrame([(1, "m0", ["item"]), (2, "m0", ["round"]), (3, "m0", ["nothing"])], "ref long, module string, segments array<string>")
    externs = spark.createDataFrame([], "crate string, name string, root string")
    got = {r["ref"]: (r["tag"], r["target"]) for r in resolve.resolve(paths, modules, names, spark.createDataFrame(imports, "module string, name string, segments array<string>, public boolean"), externs).collect()}
    assert got == {1: ("item", "ITEM"), 2: ("unresolved", None), 3: ("unresolved", None)}


def test_tools_stand_as_deep_as_they_are(spark):
    rows = [(f"t{i}", f"t{i - 1}" if i else None, i, f"n{i}") for i in range(22)] + [("x", "y", 0, "x"), ("y", "x", 0, "y")]
    got = {r["id"]: (r["depth"], r["pos"]) for r in tools.preorder(spark.createDataFrame(rows, "id string, parent string, line int, name string")).collect()}
    assert got == {f"t{i}": (i, i) for i in range(22)}


def test_what_is_changed_in_work_trees(spark):
    out = "1 A. N... 0 0 0 a b new file\0" + "1 .M N... 0 0 0 a b m\0" + "1 .D N... 0 0 0 a b d\0" + "2 R. N... 0 0 0 a b R100 to\0from\0" + "u UU N... 0 0 0 0 a b c both\0" + "? some new\0"
    got = sorted((r["kind"], r["path"]) for r in git.status_files(spark.createDataFrame([("w", out)], "worktree string, output string")).collect())
    assert got == [("added", "new file"), ("conflicted", "both"), ("deleted", "d"), ("modified", "m"), ("renamed", "to"), ("untracked", "some new")]


def test_owners_of_tags_stand_right_below(spark):
    text = "// @route GET /a\nlet x = 1;\nfn f() {}\n// @route GET /b\n// more\n#[cfg(\n  all)]\n#[inline]\nfn g() {}\nfn h() {} // @route GET /c\n\n// @route GET /d\n\nfn i() {}\n"
    files = spark.createDataFrame([("a.rs", text)], "path string, text string")
    spans = extract.items(files).where("kind = 'fn'")
    got = {(r["line"], r["owner"]) for r in extract.tag_owners(extract.tags(files), spans).collect()}
    assert got == {(1, None), (4, "g"), (10, None), (12, None)}


def test_tasks_at_a_time_with_short_and_long_spans(spark):
    rng = random.Random(3)
    states = [(rng.randrange(3), rng.randrange(4), rng.choice([rng.randrange(-50, 50), rng.randrange(5000)]), n, rng.choice(["in_progress", "done", "pending"])) for n in range(150)]
    touches = [(n, rng.randrange(4), rng.choice([rng.randrange(-60, 60), rng.randrange(6000)])) for n in range(120)]
    got = {r["touch"]: r["task"] for r in sessions.task_at(spark.createDataFrame(touches, "touch long, session long, time long"), spark.createDataFrame(states, "session long, task long, time long, seq long, state string")).collect()}
    want = {}
    for touch, session, time_ in touches:
        last = {}
        for s, task, at, seq, state in sorted(states, key=lambda x: (x[2], x[3])):
            if s == session and at <= time_:
                last[task] = (at, task, state)
        open_ = [(at, task) for at, task, state in last.values() if state == "in_progress"]
        if open_:
            want[touch] = max(open_)[1]
    assert got == want
    assert sessions.task_at(spark.createDataFrame([], "touch long, session long, time long"), spark.createDataFrame(states, "session long, task long, time long, seq long, state string")).collect() == []
