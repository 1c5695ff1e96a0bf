"""SimHash groups against a plain version."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphweft.llm import common, components, near_copies, simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprint_is_the_plain_one():
    rng = random.Random(1)
    texts = ["", " \t\n", "one", "One TWO three", "a b c d", "a b c d e", "É é Ünïcode ΑΒΓ", "x\x0by\x0cz w v", "a b c d e"]
    texts += [" ".join(rng.choice(["ab", "Cd", "é", "longer"]) for _ in range(n)) for n in (4, 7, 200)]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t), t


def test_golay_words_two_bits_apart_share_a_key():
    tables = simhash.golay_tables()
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    k, ok = simhash.golay_keys(words, tables)
    for bits in [(i,) for i in range(23)] + list(combinations(range(23), 2)):
        k2, ok2 = simhash.golay_keys(words ^ sum(1 << b for b in bits), tables)
        assert ((k[:, :, None] == k2[:, None, :]) & ok[:, :, None] & ok2[:, None, :]).any(axis=(1, 2)).all()


def test_all_errors_of_four_bits_meet_in_a_bucket():
    tables, rng = simhash.golay_tables(), np.random.default_rng(1)
    a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for _ in a], np.uint64)
    keys = [[set() for _ in a] for _ in range(2)]
    for side, fps in enumerate((a, a ^ flips)):
        for row, key in zip(*simhash.bucket_keys(fps, tables), strict=True):
            keys[side][row].add(int(key))
    assert all(x & y for x, y in zip(*keys, strict=True))


def test_all_errors_of_four_bits_meet_by_all_segments():
    tables, rng = simhash.golay_tables(), np.random.default_rng(2)
    a = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    wide = [rng.choice(range(lo, hi), rng.integers(3, 5), replace=False) for lo, hi in ((0, 22), (22, 43), (43, 64)) for _ in range(200)]
    wide += [rng.choice(64, rng.integers(1, 5), replace=False) for _ in range(400)]
    flips = np.array([sum(1 << int(b) for b in bits) for bits in wide], np.uint64)
    keys = [[set() for _ in a] for _ in range(2)]
    for side, fps in enumerate((a, a ^ flips)):
        for row, key in zip(*simhash.finer_keys(fps, tables), strict=True):
            keys[side][row].add(int(key))
    assert all(x & y for x, y in zip(*keys, strict=True))
    assert np.mean([len(k) for k in keys[0]]) < 200  # keys a fingerprint, whatever the bucket


def near(rng, n, centre):
    return [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(n)]


def links_of(spark, fps, limit, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", limit)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"))
    return {r["node"] % (1 << 64): r["component"] % (1 << 64) for r in components.connected_components(edges).collect()}


def check_links(spark, limit, monkeypatch):
    rng = random.Random(limit)
    fps = sorted(set(near(rng, 150, 0x0123456789ABCDEF) + near(rng, 60, 0) + [rng.getrandbits(64) for _ in range(200)]))
    got, want = links_of(spark, fps, limit, monkeypatch), plain_groups(fps)
    for a, b in combinations(fps, 2):
        assert (got.get(a, a) == got.get(b, b)) == (want[a] == want[b])


def test_links_are_the_plain_ones(spark, monkeypatch):
    check_links(spark, 2048, monkeypatch)


def test_buckets_over_the_limit_lose_no_link(spark, monkeypatch):
    check_links(spark, 12, monkeypatch)


@pytest.mark.parametrize("limit", [3, 5])
def test_full_buckets_at_all_levels_lose_no_link(spark, monkeypatch, limit):
    """Buckets of longer keys are full, too, and hold several components that only single bridges connect."""
    rng, fps = random.Random(limit), set()
    for centre in (0, 0x0F0F0F0F0F0F0F0F):
        for _ in range(120):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
        fps.update(centre ^ (0b111111 << at) for at in range(0, 24, 6))
    fps = sorted(fps)
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 16)
    got, want = links_of(spark, fps, limit, monkeypatch), plain_groups(fps)
    for a, b in combinations(fps, 2):
        assert (got.get(a, a) == got.get(b, b)) == (want[a] == want[b])


def test_a_dense_ball_gives_a_forest(spark, monkeypatch):
    """Thousands of fingerprints close to each other: links stay a few a fingerprint, and no longer keys are made."""
    rng = random.Random(8)
    fps = sorted({sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(6000)})
    made = []
    own = simhash._bucketed
    monkeypatch.setattr(simhash, "_bucketed", lambda *a: made.append(own(*a)) or made[-1])
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 256)
    links = simhash.fingerprint_links(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long"))
    assert links.count() <= 4 * 2 * len(fps)  # a forest a task
    assert made[0].where("b is null").count() < 300 * len(fps)
    assert components.connected_components(links).select("component").distinct().count() == 1


def test_edges_of_a_hub_are_spread(spark):
    """No partition of a join on the hub gets most of its edges."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = common.settle(spark.createDataFrame([(0, i) for i in range(1, 20_000)], "a long, b long"))
        table = edges.groupBy("a").count().withColumnRenamed("count", "n").withColumn("p", F.lit(1))
        sizes = [r[1] for r in common.join_spread(edges.repartition(8), table, "a").groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 5000 and sum(sizes) == edges.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_frequent_keys_are_few(spark, monkeypatch):
    rows = common.settle(spark.range(4000).selectExpr("if(id % 3 = 0, 7, id) k"))
    assert [r["k"] for r in common.frequent(rows, "k").collect() if r["n"] > 10] == [7]
    monkeypatch.setattr(common, "MOST_ROWS", 100)
    assert [tuple(r) for r in common.frequent(rows, "k").collect() if r["n"] > 100] == [(7, 1335)]


def test_runs_cut_across_batches():
    import pyarrow as pa

    keys = np.repeat([1, 2, 3], [2, 9, 3])
    fps = np.arange(len(keys))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 3]), pa.array(fps[i : i + 3]), pa.array(fps[i : i + 3])], ["key", "fp", "c"]) for i in range(0, len(keys), 3)]
    whole = [(own[0].tolist(), hot) for own, hot in simhash._runs(batches, 4)]
    assert sum(len(k) for k, _ in whole) == 14
    assert {k for ks, hot in whole if hot for k in ks} == {2}


def test_groups_with_nulls_repeats_and_extra_columns(spark):
    text = "one two three four five six seven eight"
    rows = [(5, text, "x"), (3, text.upper(), "y"), (3, text.upper(), "y"), (9, None, None), (8, "", "z"), (None, "  ", "z"), (None, "only here and nowhere else at all", "z"), (1, "quite different words stand in this one row", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumnRenamed("component_id", "fp")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs).collect())
    assert len(got) == 8
    by = {g[1]: g for g in got if not g[0]}
    assert by[5][3] == by[3][3] == 3 and by[9][3] == by[8][3] == 8 and by[8][2] == "0" * 16 and by[1][3] == 1
    assert [g[3] for g in got if g[0]].count(8) == 1
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "8", "None", "None"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(docs).collect() == [] and simhash.keep_first(docs).collect() == []


@pytest.mark.parametrize("most", [2, 1 << 16])
def test_components_of_chains_stars_and_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(components, "NODE_EDGES", most)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (None, 4)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[100 + i] for i in range(30)} == {100} and got[201] == 200
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rows_are_decided_not_ids(spark):
    rng = random.Random(11)
    a, b, c, d = (" ".join(f"{n}{rng.randrange(999)}" for _ in range(40)) for n in "abcd")
    rows = [(3, b, 1), (8, a, 2), (8, b, 3), (9, c, 4), (9, d, 5), (9, d, 5), (9, d, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other long")
    kept = sorted(tuple(r) for r in simhash.keep_first(docs).collect())
    assert [(i, t) for i, t, _ in kept] == sorted([(3, b), (8, a), (9, c), (9, d)])
    assert kept == sorted(tuple(r) for r in simhash.keep_first(docs.repartition(3)).collect())


def test_rows_are_left_out_by_a_join_too(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one text of {i % 3} many words that all rows like it have", i) for i in range(30)], "doc_id long, text string, own_id long")
    few = sorted(map(str, simhash.keep_first(docs).collect()))
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert few == sorted(map(str, simhash.keep_first(docs).collect()))


def test_a_text_of_over_65536_shingles():
    rng = random.Random(12)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(70_000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
