"""Mixing, packing, URL filters and the pipeline."""

import importlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphweft.llm import common, mixing, near_copies, packing, urls

corpus_pipeline = importlib.import_module("corpus_pipeline")


def plain_targets(sizes):
    """By rounds: clamp what exceeds its cap, share the excess by weight again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def documents(spark, n, seed, sources=7):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(0.7) % 900)), rng.choice([None, *[f"s{k}" for k in range(sources)], "s0", "s0", "s0"]), "x", 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, part string, n_chars long"), rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, seed):
    docs, rows = documents(spark, 400, seed)
    sizes, of = Counter(), {}
    for i, text, source, *_ in rows:
        of[i] = (source, len(text.split()))
        sizes[source] += len(text.split())
    targets, taken = plain_targets(dict(sizes)), Counter()
    got = mixing.mix(docs).collect()
    assert len(got) == 400
    for r in got:
        source, size = of[r["doc_id"]]
        assert r["size"] == size and r["source_size"] == sizes[source] and abs(r["target"] - targets[source]) < 1e-6 * max(1, targets[source])
        assert 0 <= r["taken"] <= 3 * size
        taken[source] += r["taken"]
    for source, target in targets.items():
        assert target - 3 <= taken[source] <= target
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].split())
    assert words == {s: n for s, n in taken.items() if n}


def test_mix_of_nothing_and_of_odd_rows(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    odd = spark.createDataFrame([(1, None, None), (None, "a b c", "x"), (2, " \t", "x"), (2, " \t", "x"), (3, "a\x0bb c", "")], "doc_id long, text string, source string")
    got = mixing.mix(odd).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 0, 2, 3] and sum(r["taken"] for r in got) in (4, 5)
    assert all(r["taken"] == 0 for r in mixing.mix(odd.where("doc_id = 1")).collect())


def check_bins(rows, capacity, words):
    held, sources, groups, seen = Counter(), defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows:
        seen[r["doc_id"], r["copy"], r["group_id"]].append((r["start_word"], r["n_words"]))
        if r["bin_id"] is None:
            assert r["n_words"] == 0
            continue
        held[r["bin_id"]] += r["n_words"]
        sources[r["bin_id"]].append(r["source"])
        groups[r["bin_id"]].append(r["group_id"])
    assert max(held.values(), default=0) <= capacity
    assert all(len(s) == len(set(s)) for s in (*sources.values(), *groups.values()))
    for parts in seen.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    assert sum(held.values()) == words


def test_packing_holds_its_conflicts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join([f"w{i % 60}"] * rng.randint(0, 90)), rng.choice(["a", "a", "a", "b", "c", None, *map(str, range(15))])) for i in range(300)]
    rows += [(7, "same text here", "b")] * 40 + [(None, "same TEXT  here", "b"), (900, None, "b"), (901, "long " * 500, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as bin_id", "1 as copies")
    got = packing.pack(docs, capacity=64, shard_rows=100).collect()
    check_bins(got, 64, sum(len((t or "").split()) for _, t, _ in rows))
    assert sum(r["piece"] == 0 for r in got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, packing.pack(docs.repartition(5), capacity=64, shard_rows=100).collect()))
    assert packing.pack(docs.where("false")).collect() == []


@pytest.mark.parametrize("block_rows", [4096, 4])
def test_near_copies_share_no_bin(spark, monkeypatch, block_rows):
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", block_rows)  # bands dealt to pairs of blocks lose no link
    rng = random.Random(5)
    rows, sets = [], []
    for k in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 60, 200]))]
        for n in range(rng.choice([1, 4, 25])):
            own = list(words)
            for _ in range(n % 7):  # from copies with a word changed to some that are no longer near
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            own += ["a", "line", "added"] * (n % 2)
            rows.append((len(rows), " ".join(own), f"s{len(rows)}"))
            sets.append({tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))})
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 10 * len(x & sets[j]) >= 8 * len(x | sets[j]) and label[i] != label[j]:
                label = [label[j] if c == label[i] else c for c in label]
    assert 12 < len(set(label)) < len(rows)
    got = {r["doc_id"]: r for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    groups = [got[i]["group_id"] for i in range(len(rows))]
    assert len(set(zip(label, groups, strict=True))) == len(set(label)) == len(set(groups))
    assert len({(r["bin_id"], label[i]) for i, r in got.items()}) == len(rows)


def _filtered(spark, n=400, copies=12):
    """(rows read, texts, their xh) of n texts, some of which have near copies."""
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(n)]
    base += [b + f" tail{k}" for k in range(3) for b in base[:copies]]
    rows = spark.createDataFrame([(i, "s", t) for i, t in enumerate(base)], "doc_id long, source string, text string").withColumn("xh", F.xxhash64("text")).select("doc_id", "source", "xh", "text")
    read = common.settle(rows.mapInArrow(near_copies.hashed, "doc_id long, source string, xh long, text_hash long, size long, bands array<long>, mark binary"))
    return read.withColumnRenamed("text_hash", "grp"), rows.select("xh", "text")


@pytest.mark.parametrize(("bits", "most"), [(20, 1 << 24), (16, 1 << 24), (20, 0)])
def test_the_prefilter_changes_nothing(spark, monkeypatch, bits, most):
    """A bitmap, one that is small, and none, but a join of the texts that are asked for."""
    monkeypatch.setattr(near_copies, "LEAST_BITS", bits)
    monkeypatch.setattr(near_copies, "MOST_BITS", bits)
    monkeypatch.setattr(near_copies, "FILTER_TEXTS", most)
    monkeypatch.setattr(near_copies, "SEEN_TEXTS", 5)
    groups = near_copies.near_copy_groups(*_filtered(spark))
    assert groups.count() == 48 and groups.select("cluster").distinct().count() == 12


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_only_sets_of_asked_texts_are_made(spark, monkeypatch, most):
    """However full a bitmap of fixed size would be: the sets made are those asked for and few others."""
    monkeypatch.setattr(near_copies, "FILTER_TEXTS", most)
    monkeypatch.setattr(near_copies, "LEAST_BITS", 16)
    _, texts = _filtered(spark, 20_000, 0)
    names = common.settle(texts.select("xh", F.col("xh").alias("grp")).where("xh % 2 = 0"))  # half of all: a share of a map of 2**16 bits is set
    made = []
    own = near_copies._gram_sets
    monkeypatch.setattr(near_copies, "_gram_sets", lambda asked, power: made.append((asked, power)) or own(asked, power))
    assert near_copies._sets(texts, names).count() == names.count()
    asked, power = made[0]
    if most:
        assert power >= 16 and int(np.unpackbits(asked).sum()) <= (1 << power) / 8  # at most an eighth of the others pass
    else:
        assert asked is None


def test_frequent_keys_stay_where_they_are(spark, monkeypatch):
    rng = random.Random(8)
    keys = [7] * 600 + [9] * 90 + [rng.randrange(10**6) for _ in range(700)]
    rows = spark.createDataFrame(list(enumerate(keys)), "at long, k long")
    table = spark.createDataFrame([(k, keys.count(k), -k) for k in set(keys)], "k long, n long, value long")
    for least in (1, 3, 40, 2048):
        monkeypatch.setattr(common, "FREQUENT", least)
        want = {k: keys.count(k) for k in keys if keys.count(k) * least > len(keys)}
        assert {r["k"]: r["n"] for r in common.frequent(rows, "k").collect()} == want and len(want) < max(2, least)
        joined = common.join_spread(rows, table, "k")
        assert set(joined.columns) == {"at", "k", "value"}
        assert sorted((r["at"], r["value"]) for r in joined.collect()) == [(i, -k) for i, k in enumerate(keys)]
    assert common.frequent(rows.where("false"), "k").collect() == common.join_spread(rows.where("false"), table.where("false"), "k").collect() == []


def test_links_between_the_blocks_of_a_band_are_found(spark, monkeypatch):
    """One large group of near copies, and chains that meet it and each other only in other blocks of its bands."""
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 6)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = [[*base[:k], f"x{k}", *base[k + 1 :]] for k in range(60)]  # a word changed: all near each other
    for start in range(3):  # a word more at a step: near only to the last steps, the first near to the large group
        own = list(base)
        for step in range(24):
            own = list(own)
            own[6 * step + start] = f"y{start}.{step}"
            if start != 2 or step > 15:  # the third chain lacks what leads to the group
                texts.append(own)
    rng.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 10 * len(x & sets[j]) >= 8 * len(x | sets[j]) and label[i] != label[j]:
                label = [label[j] if c == label[i] else c for c in label]
    assert 1 < len(set(label)) < 10
    got = packing.pack(spark.createDataFrame([(i, " ".join(t), f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    groups = [r["group_id"] for r in sorted(got, key=lambda r: r["doc_id"])]
    assert len(set(zip(label, groups, strict=True))) == len(set(label)) == len(set(groups))


def test_long_runs_of_a_band_are_compared_like_short_ones():
    rng = random.Random(15)
    words = [f"w{i}" for i in range(120)]
    texts = [[w if rng.random() > 0.02 * (i % 6) else f"x{rng.random()}" for w in words] for i in range(90)]
    rows = []
    for i, own in enumerate(texts):
        bands, mark = near_copies.bands_of(near_copies.all_grams([w.encode() for w in own]))
        rows += [(int(k), 0, 0, 0, i, bands.tolist(), mark) for k in bands]
    rows.sort(key=lambda r: r[0])
    table = pa.Table.from_pylist([dict(zip(("key", "i", "j", "side", "grp", "bands", "mark"), r, strict=True)) for r in rows])
    pairs = []
    for run in (1, 48):
        near_copies.SHORT_RUN, kept = run, near_copies.SHORT_RUN
        found = near_copies._Rows(table)
        a, b, equal = found.pairs()
        near_copies.SHORT_RUN = kept
        grp = table["grp"].to_numpy()
        pairs.append(sorted((min(grp[x], grp[y]), max(grp[x], grp[y]), int(e)) for x, y, e in zip(a, b, equal, strict=True)))
    assert pairs[0] == pairs[1] and len({p[:2] for p in pairs[0]}) == len(pairs[0]) > 100


def plain_place(bins, capacity, size, source, group):
    fitting = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and source not in b["sources"] and (group is None or group not in b["groups"])]
    if fitting:
        i = min(fitting)[1]
    else:
        bins.append({"left": capacity, "sources": set(), "groups": set()})
        i = len(bins) - 1
    at = capacity - bins[i]["left"]
    bins[i]["left"] -= size
    bins[i]["sources"].add(source)
    bins[i]["groups"].add(group)
    return i, at


def test_best_fit_is_the_plain_one():
    rng = random.Random(8)
    for capacity, n in ((50, 400), (20, 200)):
        bins, plain = packing.Bins(capacity), []
        for _ in range(n):
            size, source, group = rng.randint(1, capacity), rng.choice([0, 0, 0, *range(6)]), rng.choice([None, None, *range(9)])
            want = plain_place(plain, capacity, size, source, group)
            assert bins.place(size, 1 << source, 0 if group is None else 1 << group) == want


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match("[^/?#]*", rest)[0])
    path = re.match("[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = ["http://a.example.NET/en/1", "https://x.net/", "http://x.net", "http://net/a", "ftp://EXAMPLE.com/de/x?y=/fr/", "http://notexample.com/de/", "https://w.org/fr/", "https://w.org/fr", "a.org/fr/", "://org/fr/#://net/", "http://x.net?/", "http://É.org/fr/ü", "", None, "http://h" + "/x" * 5000, "http://org/fr/\nnet", "http://a.net\\/b/"]


def test_rules_and_parts_are_the_plain_ones(spark):
    rows = [(i, u, "z") for i, u in enumerate(URLS)] + [(None, URLS[0], "z"), (0, URLS[0], "z")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        url = URLS[0] if r["page_id"] is None else URLS[r["page_id"]]
        host, path, rule, verdict = plain_url(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert r["verdict"] in ("block", "allow") and (verdict is None or r["verdict"] == verdict)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
    assert {r["verdict"] for r in urls.judge(spark.createDataFrame([(1, "http://x.io/a")], "page_id long, url string")).collect()} == {"allow"}


def test_held_out_urls(spark):
    rng = random.Random(3)  # one suffix, so that only the other features tell
    long = lambda: "".join(rng.choice("0123456789abcdefghijk") for _ in range(rng.randint(20, 60)))
    short = lambda: rng.choice(["news", "home", "about", "team"])
    made = [(i, f"http://h{i % 9}.net/{long()}/{long()}?a=1&b={i}") if i % 2 else (i, f"http://h{i % 9}.example.net/en/{short()}") for i in range(900)]
    rows = urls.labelled(spark.createDataFrame(made, "page_id long, url string")).where("ruled is not null")
    model = urls.fit_trees(urls.training_rows(rows.where("page_id % 3 > 0")))
    told = rows.where("page_id % 3 = 0").selectExpr("ruled = 'block' as y", "*").withColumn("margin", model.margin()).selectExpr("avg(double((margin >= 0) = y))", "avg(double(y))").first()
    assert told[0] > 0.97 and 0.4 < told[1] < 0.6 and model.trees


def test_pipeline_keeps_its_promises(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = corpus_pipeline.settle(stage(spark, before, sf))
        if name != "best_fit_packing":
            assert kept.columns == columns
        if name in ("toxicity", "simhash_near_dedup"):
            assert kept.exceptAll(before).isEmpty()
    rows = kept.collect()
    check_bins(rows, packing.CAPACITY, before.selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'))").first()[0])
    assert sorted(map(str, rows)) == sorted(map(str, corpus_pipeline.run(spark, sf).collect()))


def test_stages_on_odd_rows_and_nothing(spark, tmp_path):
    rows = [(1, None, None, None), (2, "", "s", 0), (2, "", "s", 0), (None, None, None, None), (None, "a b c d e f", None, 11), (3, "a b c d e f", "", 11)]
    rows += [(4, "password = hunter2hunter2 " * 3, "s", 5), (5, "word " * 100_000, "t", 5), (6, "x" * 500_000, "t", 5), (8, "same text here", "t", 3), (8, "same text here", "t", 3)]
    names = "part key size toxic h component_id fp a b node copy rest shard grp target whole some of taken bin_id spans".split()
    docs = spark.createDataFrame([r + tuple(names) for r in rows], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (3, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    for number, (docs, labels) in enumerate([(docs, labels), (docs, labels.where("false")), (docs.where("false"), labels)]):
        folder = f"{tmp_path}/{number}"
        labels.write.parquet(f"{folder}/labels.parquet")
        kept, counts = docs, []
        for name, stage in corpus_pipeline.STAGES:
            words = kept.selectExpr("coalesce(sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')), 0)").first()[0]
            kept = corpus_pipeline.settle(stage(spark, kept, folder))
            assert name == "best_fit_packing" or kept.columns == docs.columns
            counts.append(kept.count())
        check_bins(kept.collect(), packing.CAPACITY, words)
        # Nothing toxic is told; of null, empty and repeated texts one stays, and rows without an id.
        assert counts[:3] == ([0, 0, 0] if number == 2 else [11, 8, 8])  # ids 1, 3, 4, 5, 6 and 8, and two without
