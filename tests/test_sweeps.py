"""Spans swept by ranges, and percentiles by histograms, against plain versions."""

import math
import random

import pytest

from graphweft.operators import extract, percentiles, spread


def plain(points, spans):
    out = {}
    for path, line in points:
        met = [(b - a, n) for p, a, b, n in spans if p == path and None not in (a, b) and line is not None and a <= line <= b]
        if met:
            out[path, line] = min(met)[1]
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_innermost_spans(spark, parts):
    """One file with most rows over many ranges, spans across all of them, equal spans, nulls and repeats."""
    rnd = random.Random(parts)
    path = lambda: rnd.choice(["hot"] * 8 + ["a", "b", "c"])
    spans = [("hot", 0, 10_000, 99), ("hot", 5, 9_000, 98), ("hot", 5, 9_000, 97), ("a", 3, 2, 1), ("b", None, 4, 1)]
    for i in range(600):
        a = rnd.randrange(3000)
        spans.append((path(), a, a + int(rnd.paretovariate(0.5) % 800), 100 + i))
    points = [(path(), rnd.randrange(-5, 3500)) for _ in range(900)] + [("hot", 6), ("hot", 6), ("none", 1), ("a", None), (None, 3)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        p = spark.createDataFrame(points, "path string, line int").repartition(3)
        got = extract.innermost(p, spark.createDataFrame(spans, "path string, line int, line_end int, name long").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["path"], r["line"]): r["name"] for r in got} == plain({x for x in points if x[0]}, spans) and len(got) == len({(r["path"], r["line"]) for r in got})


def test_spans_meet_no_points_in_a_join(spark):
    """What meets by path is what is open at the borders of ranges, not spans and points."""
    p, s = spark.createDataFrame([("f", 1)], "path string, line int"), spark.createDataFrame([("f", 1, 2, "x")], "path string, line int, line_end int, name string")
    plan = extract.innermost(p, s)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "to#" in plan  # carried spans to the ranges they reach
    assert extract.innermost(p.where("false"), s).collect() == [] and extract.innermost(p, s.where("false")).collect() == []


@pytest.mark.parametrize("heavy", [50, 1 << 20])
def test_percentiles(spark, monkeypatch, heavy):
    monkeypatch.setattr(spread, "KEY_ROWS", heavy)
    monkeypatch.setattr(percentiles, "BINS", 8)
    rnd, rows = random.Random(1), []
    for i in range(1500):
        rows.append((rnd.choice(["hot"] * 5 + ["a", None]), rnd.choice([rnd.gauss(0, 1), rnd.lognormvariate(0, 30), -rnd.lognormvariate(0, 90), 7.0, 7.0, 0.0, None, math.nan, math.inf][: 9 if i % 9 == 0 else 8])))
    rows += [("one", 3.5), ("same", 2.0), ("same", 2.0), ("void", None)] + [("tiny", 5e-324 * k) for k in range(40)] + [("close", 1 + k * 2**-52) for k in range(40)]
    shares = {"least": 0.0, "p07": 0.07, "p50": 0.5, "p95": 0.95, "p99": 0.99, "most": 1.0}
    rows = [r for r in rows if r[1] is None or not math.isinf(r[1])]
    got = {r["grp"]: [r[n] for n in shares] for r in percentiles.percentiles(spark.createDataFrame(rows, "grp string, x double"), "grp", "x", shares).collect()}
    want = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            want.setdefault(g, []).append(v)
    want = {g: [sorted(v)[max(0, -(-round(s * 100) * len(v) // 100) - 1)] for s in shares.values()] for g, v in want.items()}
    assert got == want
