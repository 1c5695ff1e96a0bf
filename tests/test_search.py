"""Fuzzy scores by hand, and search against a plain version over all entries."""

import random

from graphweft.operators import search as S


def test_scores_by_hand():
    # h: hump 16 + 16 + base 6 + late -9; u, d: 16 + 6 + contiguous 12 each
    assert S.fuzzy("hud", "ObjectiveHUD", "objectivehud") == (16 + 16 + 6 - 9 + 2 * (16 + 6 + 12), (9, 10, 11))
    whole = S.fuzzy("hud", "hud", "hud")
    assert whole[0] == 3 * 22 + 20 + 2 * 12 + 40 + 100
    assert S.fuzzy("hdu", "hud", "hud") is None
    assert S.fuzzy("", "x", "x") is None
    assert S.fuzzy("ab", "a_xb", "a_xb")[0] - S.fuzzy("ab", "a_xxb", "a_xxb")[0] == 1
    path = S.fuzzy("a/b", "a/b", "a/b")
    assert path[0] == 16 + 20 + 16 + 12 + 16 + 20 + 6 + 12 + 100


def test_scope_and_fold():
    assert S.scope("  >run") == ("commands", "run")
    assert S.scope("@ Foo ") == ("symbols", "foo")
    assert S.scope("İx")[1] == "İx"


def test_caps_and_total_order(spark):
    rows = [("File", f"a{i}.rs", "", f"src/a{i}.rs", None, i) for i in range(30)] + [("Tool", "a", "", None, None, i) for i in range(9)]
    entries = S.prepared(spark.createDataFrame(rows, "kind string, name string, detail string, path string, line int, key long"))
    found = S.search(entries, "a").collect()
    files, tools = [r for r in found if r["grp"] == 0], sorted((r for r in found if r["grp"] == 3), key=lambda r: r["pos"])
    assert len(files) == 8 and {r["total"] for r in files} == {30}
    assert [r["key"] for r in tools] == [0, 1, 2, 3, 4] and {r["total"] for r in tools} == {9}
    scoped = S.search(entries, ">a").collect()
    assert len(scoped) == 9
    assert S.search(entries, "   ").count() == 0


def test_search_is_the_plain_version(spark):
    names = ["ObjectiveHud", "hud_base", "src hud", "shroud", "HUD", "nope"]
    rows = [("Symbol", n, "", f"ui/{n.lower()}.rs", i, i) for i, n in enumerate(names)]
    entries = S.prepared(spark.createDataFrame(rows, "kind string, name string, detail string, path string, line int, key long"))
    got = {r["name"]: (r["score"], r["in_path"]) for r in S.search(entries, "hud").collect()}
    for _, n, _, path, _, _ in rows:
        own, far = S.fuzzy("hud", n, n.lower()), S.fuzzy("hud", path, path)
        points = None if far is None else 3 * far[0] // 4
        if own is None and points is None:
            assert n not in got
        elif own is None or (points is not None and points > own[0]):
            assert got[n] == (points, True)
        else:
            assert got[n] == (own[0], False)


def test_an_index_finds_what_a_scan_finds(spark):
    """Queries of one and more characters, of repeated ones and of others than the index knows; few entries are read."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeXY_-.é\U0001f600 1") for _ in range(rnd.randrange(1, 14)))
    rows = [(rnd.choice(["Symbol", "File", "Tool", "Command", "Folder"]), word(), "", rnd.choice([None, "", f"{word()}/{word()}"]), rnd.choice([None, i]), i) for i in range(700)]
    entries = spark.createDataFrame(rows, "kind string, name string, detail string, path string, line int, key long")
    held, index = S.pair_index(entries)
    plain = S.prepared(entries)
    for query in ("a", "ab", "bcd", "aa", "a_b", "X1y", ">ab", "@ é1a", "\U0001f600a", "a b c", "zzz", "abcdeab", ""):
        scan, found = ([tuple(r) for r in df.drop("positions").collect()] for df in (S.search(plain, query), S.search_indexed(held, index, query)))
        assert sorted(scan, key=repr) == sorted(found, key=repr), query
    assert S.candidates(held, index, "abcd").count() < 0.2 * held.count()
    masks = plain.where(S.F.col("name_mask").bitwiseAND(S.F.lit(S.mask_of("abcd"))) == S.mask_of("abcd")).count()
    assert S.candidates(held, index, "abcd").where("kind in ('Tool', 'Command')").count() <= masks
