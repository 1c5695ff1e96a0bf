"""Merkle manifests against a plain version, and proofs that hold or fail."""

import random
import zlib
from hashlib import sha256

import pytest

from graphweft.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, part string, leaf string, place string, row string"


def h(text):
    return sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 16 * 16
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 16])))
        i //= 16
    return out


def brute(rows):
    sources = {}
    for d, s, lang, n, text in rows:
        leaf = start = h("".join(map(field, (d, s, lang, n, text))))
        if d is not None and text is not None and zlib.crc32(str(d).encode()) % 5 == 0:
            start = h("".join(map(field, (d, s, lang, n, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))))
        sources.setdefault(s, []).append((d is not None, d or 0, leaf, start, d))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    top, out = tree([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for i, (_, _, leaf, start, d) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            sides, node = way(trees[s], i) + way(top, k), start
            for a, b in sides:
                node = h(a + node + b)
            out.append((d, leaf, trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in sides)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def check(df):
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in merkle.manifest(df).select(*COLUMNS).collect()), key=repr)
    assert got == (brute(rows) if rows else [])
    return got


def odd_rows(n, ids=300):
    rnd = random.Random(1)
    source = lambda: rnd.choice(["hot"] * 20 + [None, "", "a", "é", "z", *map(str, range(40))])
    return [(rnd.choice([None, *range(ids)]), source(), rnd.choice([None, "en"]), rnd.choice([None, 1, 22]), rnd.choice([None, "", "Abc", "Ünï ABC", "X" * 20_000]), "c", "c", "c", "c") for _ in range(n)]


@pytest.mark.parametrize("rows", [8, 1 << 16])
def test_equals_plain_version(spark, monkeypatch, rows):
    """Nulls, ties, repeated rows, clashing columns, a source over many ranges and many sources in one."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", rows)
    got = check(spark.createDataFrame(odd_rows(1200), SCHEMA).repartition(3))
    assert {g[-1] for g in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257])
def test_sizes(spark, n):
    check(spark.createDataFrame([(i, "s", "en", 3, "Text") for i in range(n)], SCHEMA.split(", part")[0]))


def test_many_sources(spark):
    check(spark.createDataFrame([(i, f"s{i}", "en", 3, "Text") for i in range(300)], SCHEMA.split(", part")[0]))


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_ranges_build_all_but_their_borders():
    """The nodes that leave a range are a few a level, whatever its length."""
    leaves = [str(i) for i in range(5000)]
    left = list(merkle._ragged(merkle._build(leaves, 777, 100_000)))
    assert len(left) <= 2 * 15 * merkle._levels(100_000) and {lv for lv, *_ in left} == {0, 1, 2, 3} - ({3} - {lv for lv, *_ in left})
    assert [n for n in merkle._ragged(merkle._build(leaves, 0, 5000))] == [(4, 0, tree(leaves)[-1][0])]
    whole = tree(leaves)
    parts = [merkle._build(leaves[a:b], a, 5000) for a, b in ((0, 1000), (1000, 1003), (1003, 4999), (4999, 5000))]
    for built in parts:
        for level, (first, nodes) in enumerate(built):
            assert not nodes or nodes == whole[level][first : first + len(nodes)]
