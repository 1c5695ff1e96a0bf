"""Embedding groups and top-k against plain versions."""

import math

import numpy as np
import pytest

from graphweft.llm import embed_dedup, topk


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 7) for i, v in rows], "vec_id long, embedding array<float>, component_id int")


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    for i in range(0, n, 4):
        base[i + 1 : i + 3] = base[i] + rng.normal(size=(len(base[i + 1 : i + 3]), dim)) * 0.12
    return base.astype(np.float32)


def plain_groups(ids, vectors, threshold=0.95):
    x = np.array(vectors, np.float64)
    norm = np.linalg.norm(x, axis=1)
    link = (x @ x.T) / norm[:, None] / norm[None, :] >= threshold
    np.fill_diagonal(link, False)
    label = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.array([min([label[i], *label[link[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    groups = {}
    for i, g in zip(ids, label, strict=True):
        groups.setdefault(g, []).append(i)
    return {i: (int(link[k].sum()), min(groups[label[k]])) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block, leaf", [(4096, 1024), (32, 8)])
def test_groups_are_the_plain_ones(spark, block, leaf):
    x = clustered(160, 6, 3)
    x[50:70] = x[50]  # copies
    ids = [int(i) for i in np.random.default_rng(4).permutation(1000)[: len(x)]]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.embedding_groups(frame(spark, zip(ids, x.tolist(), strict=True)), block_rows=block, leaf_rows=leaf).collect()}
    assert got == plain_groups(ids, x)


def test_far_blocks_are_skipped():
    boxes = [(2, *[c] * embed_dedup.LEAD, *[c] * embed_dedup.LEAD) for c in range(0, 60, 3)]
    pairs = embed_dedup.interval_pairs(boxes)
    assert all((i, i) in pairs for i in range(len(boxes))) and (0, 19) not in pairs and len(pairs) < 60
    assert embed_dedup.interval_pairs([]) == []


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0]), (2, [2, 0.1]), (3, None), (4, [0, 0]), (5, [nan, 1]), (6, [inf, 1]), (7, [None, 1]), (8, []), (9, [1, 0, 0]), (None, [1, 0]), (2, [2, 0.1]), (10, [-0.0, 1]), (11, [0.0, 1]), (12, [1e-38, 0]), (13, [3e38, 0])]
    got = {}
    for r in embed_dedup.embedding_groups(frame(spark, rows)).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got[1] == [(5, 1, True)] and got[2] == [(5, 1, False)] * 2 and got[12] == [(5, 1, False)] and got[13] == [(5, 1, False)]
    for i in (3, 4, 5, 6, 7, 8, 9):
        assert got[i] == [(0, i, True)]
    assert got[None] == [(5, 1, None)] and got[11] == [(1, 10, False)]


def test_rows_without_an_id_link_like_others(spark):
    rows = [(None, [1, 0]), (1, [1, 0.01]), (2, [1, -0.01]), (None, [0, 1]), (None, [0, 1]), (None, [0, -1]), (5, [-1, 0])]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.embedding_groups(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, 1, None), (1, 2, 1, True), (2, 2, 1, False), (None, 1, None, None), (None, 1, None, None), (None, 0, None, None), (5, 0, 5, True)], key=str)


def test_lengths_have_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "INTERVALS", 3)
    x, y = clustered(400, 5, 21), clustered(40, 2, 22)
    rows = [*zip(range(400), x.tolist(), strict=True), *zip(range(1000, 1040), y.tolist(), strict=True)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.embedding_groups(frame(spark, rows), block_rows=16, leaf_rows=4).collect()}
    assert got == plain_groups(list(range(400)), x) | plain_groups(list(range(1000, 1040)), y)


def test_blocks_far_apart_are_no_pair(spark, monkeypatch):
    lead = range(embed_dedup.LEAD)
    boxes = spark.createDataFrame([(2, b, *[3 * b] * embed_dedup.LEAD, *[3 * b] * embed_dedup.LEAD) for b in range(20)], "dim int, block long, " + ", ".join([f"lo{c} int" for c in lead] + [f"hi{c} int" for c in lead]))
    want = {tuple(r) for r in embed_dedup.near_pairs(boxes).collect()}
    assert {(2, b, b) for b in range(20)} <= want and len(want) < 60
    monkeypatch.setattr(embed_dedup, "INTERVALS", 4)
    assert {tuple(r) for r in embed_dedup.near_pairs(boxes).collect()} == want


def test_different_vectors_under_one_id_stay_apart(spark):
    rows = [(20, [1, 2]), (20, [2, -1]), (20, [2, -1.01]), (30, [2, -1.02]), (9, [1, 2.01])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.embedding_groups(frame(spark, rows)).collect())
    assert got == [(9, 1, 9), (20, 1, 9), (20, 2, 20), (20, 2, 20), (30, 2, 20)]


def test_empty_tables(spark):
    assert embed_dedup.embedding_groups(frame(spark, [])).collect() == []
    assert topk.top_k(frame(spark, [])).collect() == []


def plain_top(rows, k, every):
    """By rows: every row with a divisible id asks, every other row answers; null ids last among ties."""
    v = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows]
    out = []
    for n, (i, q) in enumerate(v):
        if i is not None and i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), j is None, j or 0) for m, (j, w) in enumerate(v) if m != n and len(w) == len(q))
            out += [(i, place + 1, None if none else j, -s) for place, (s, none, j) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("scale", [1.0, 3000.0, 1e7])
def test_top_k_is_the_plain_one(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    x = clustered(150, 5, 9) * scale
    x[40:90] = x[40]  # ties
    rows = list(zip(range(10, 160), x.tolist(), strict=True))
    assert sorted(map(tuple, topk.top_k(frame(spark, rows), k=7, every=10).collect()), key=str) == plain_top(rows, 7, 10)


def test_top_k_by_rows_with_repeats_nulls_and_ties_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    x = clustered(120, 3, 31)
    x[10:70] = x[10]
    rows = [(None if i % 11 == 3 else i % 60, v) for i, v in enumerate(x.tolist())]
    df = frame(spark, rows).selectExpr("*", "1 as row", "2 as low", "3 as no_id", "4 as bin")
    assert sorted(map(tuple, topk.top_k(df, k=9, every=10).collect()), key=str) == plain_top(rows, 9, 10)
    three = [(0, [1.0, 2.0]), (0, [2.0, 1.0]), (20, [1.0, 1.0])]
    assert sorted(map(tuple, topk.top_k(frame(spark, three)).collect()), key=str) == plain_top(three, 20, 20) and len(plain_top(three, 20, 20)) == 6


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1, 2]), (1, [1, 1]), (2, None), (3, [float("nan"), 1]), (4, [1, 1, 1]), (None, [5, 5]), (20, [0, 0]), (40, [3e38, 3e38]), (60, [None, 1])]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(frame(spark, rows)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 40), (0, 2, None), (0, 3, 1), (0, 4, 20), (20, 1, 0), (20, 2, 1), (20, 3, 40), (20, 4, None), (40, 1, 0), (40, 2, 1), (40, 3, None), (40, 4, 20)]
