"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest

from graphweft.llm import spelling

SCHEMA = "doc_id long, text string, word string, key string, length string, held string"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in found.items() if len(w) >= 7 and k >= 2}
    about = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, others in about.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(about[w]), n[form[w]] if w in form else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in spelling.spelling_variants(df).select(*COLUMNS).collect())


def made_rows():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abÀé") for _ in range(rnd.randrange(6, 10))) for _ in range(60)]
    words += ["pattern" + c for c in "abcdefghijklmnopqrstuvwxyz"] + ["x" + "attern" * 40, "y" + "attern" * 40]
    words += ["governmental", "govermental", "governmentall", "overnmental", "governnental"]
    rows = []
    for i in range(300):
        picked = [rnd.choice(words) for _ in range(20)] + ["Governmental"] * rnd.randrange(6)
        rows.append((rnd.choice([None, i, i, i]), rnd.choice([" ", "-", "1"]).join(picked), "c", "c", "c", "c"))
    # A chain of forms: each occurs ten times as often as the one before.
    rows += [(1000 + i, " ".join(["chainlin"] * 2 + ["chainlinx"] * 20 + ["chainlinxy"] * 200), "c", "c", "c", "c") for i in range(2)]
    return rows + [(1, None, "c", "c", "c", "c"), (2, "", "c", "c", "c", "c"), (3, "z" * 50_000, "c", "c", "c", "c"), (3, "z" * 50_000, "c", "c", "c", "c"), (5, "z" * 50_001, "c", "c", "c", "c"), (6, "z" * 50_001, "c", "c", "c", "c")]


@pytest.mark.parametrize("most", [1, 3, 512])
def test_equals_brute_force(spark, monkeypatch, most):
    """Whatever number of words a segment may have before more of the word is looked for."""
    monkeypatch.setattr(spelling, "SEGMENT_WORDS", most)
    rows = made_rows()
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == brute([r[:2] for r in rows])
    assert any(f and f != r for _, f, r, *_ in got)  # a way of several forms
    if most == 512:
        assert {g[0] for g in got} >= {"z" * 50_000, "z" * 50_001}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = found(docs)
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, "no word twice here", "", "", "", "")], SCHEMA)) == []


def test_a_segment_that_most_words_share_is_divided(spark, monkeypatch):
    """A half of all words: no automaton holds more of them than a pattern with one open code point has."""
    monkeypatch.setattr(spelling, "SEGMENT_WORDS", 16)
    rnd = random.Random(2)
    known = sorted({"common" + "".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000)})
    df = spelling.settle(spark.createDataFrame([(w, 2) for w in known], "word string, n long"))
    got = {}
    for r in spelling.near_words(df).collect():
        got[r["word"]] = got.get(r["word"], 0) + r["n_near"]
    by = {}
    for w in known:
        for i in range(len(w)):
            by.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
    want = Counter()
    for g in by.values():
        for w in g:
            want[w] += len(g) - 1
    assert got == {w: k for w, k in want.items() if k}


def test_difference():
    rnd = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 7))) for _ in range(2))
        assert (spelling.difference(a, b) is not None) == near(a, b)
