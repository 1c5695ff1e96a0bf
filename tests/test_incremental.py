"""Trees made anew along changed files only."""

import random

from graphweft.operators import incremental as inc

FILE = "path string, bytes long, hash long"


def nodes(df):
    return sorted(tuple(r) for r in df.select(*inc.NODE).collect())


def test_refreshing_equals_a_whole_run(spark):
    rnd = random.Random(1)
    path = lambda: "/".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 6)))
    before = {path(): (rnd.randrange(9), rnd.randrange(99)) for _ in range(150)} | {"only/child/here": (1, 1), "top": (2, 2)}
    picked = rnd.sample(sorted(before), 25)
    changes = [(p, 7, 777, False) for p in picked[:12]] + [(p, None, None, True) for p in picked[12:]] + [("only/child/here", None, None, True), ("new/deep/er/file", 3, 3, False), ("top/below", 4, 4, False), ("never/was", None, None, True), (None, 1, 1, False), ("", 1, 1, False)]
    after = dict(before)
    for p, size, value, gone in changes:
        if p:
            after.pop(p, None) if gone else after.__setitem__(p, (size, value))
    whole = lambda d: spark.createDataFrame([(p, *x) for p, x in d.items()] + [(None, 1, 1)], FILE)
    old = inc.settle(inc.tree(whole(before)))
    change_rows = spark.createDataFrame(changes, FILE + ", gone boolean")
    new = inc.settle(inc.refreshed_tree(old, change_rows))
    assert nodes(new) == nodes(inc.tree(whole(after)))
    # One changed file touches itself and its ancestors, nothing else.
    one = spark.createDataFrame([("a/b/c/x", 5, 5, False)], FILE + ", gone boolean")
    assert sorted(r["path"] for r in inc.refreshed_rows(old, one).collect()) == ["", "a", "a/b", "a/b/c", "a/b/c/x"]
    # What differs is what a comparison of all rows says.
    a, b = ({(r["path"], r["is_file"]): r["hash"] for r in t.collect()} for t in (old, new))
    want = {(*k, "added" if k not in a else "removed" if k not in b else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    assert {tuple(r) for r in inc.changed(old, new).collect()} == want
    assert inc.changed(old, old).collect() == []


def test_only_subtrees_that_differ_are_entered(spark, monkeypatch):
    rows = [(f"{a}/{b}/f{i}", 1, i) for a in "abc" for b in "xyz" for i in range(20)]
    old = inc.settle(inc.tree(spark.createDataFrame(rows, FILE)))
    new = inc.settle(inc.refreshed_tree(old, spark.createDataFrame([("b/y/f3", 1, 99, False)], FILE + ", gone boolean")))
    levels, own = [], inc.settle
    monkeypatch.setattr(inc, "settle", lambda df: levels.append(own(df)) or levels[-1])
    got = {tuple(r) for r in inc.changed(old, new).collect()}
    assert got == {("", False, "changed"), ("b", False, "changed"), ("b/y", False, "changed"), ("b/y/f3", True, "changed")}
    assert [x.count() for x in levels] == [1, 1, 1, 1]


def test_empty_trees(spark):
    none = spark.createDataFrame([], FILE)
    assert inc.tree(none).collect() == []
    made = inc.refreshed_tree(inc.tree(none), spark.createDataFrame([("a/b", 1, 1, False)], FILE + ", gone boolean"))
    assert nodes(made) == nodes(inc.tree(spark.createDataFrame([("a/b", 1, 1)], FILE)))
