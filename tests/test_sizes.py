"""What small tables with much work per row, crowded places and far values come to."""

import random

import numpy as np
from pyspark.sql import functions as F

from graphweft.functions import text
from graphweft.operators import extract, routers, routes, spatial
from graphweft.plans import scalars


def in_parts(df) -> int:
    return df.select(F.spark_partition_id().alias("part")).distinct().count()


def test_columns_are_tried_only_while_they_can_be_nearer(monkeypatch):
    calls, search = [], np.searchsorted
    monkeypatch.setattr(spatial.np, "searchsorted", lambda *a: calls.append(1) or search(*a))
    rnd = random.Random(3)
    got = spatial.column_cuts(np.full(800, 20.0), np.array([rnd.uniform(1, 50) for _ in range(800)]))
    assert got[0] == 0 and (np.diff(got) >= 0).all() and len(calls) < 10 * 800


def test_crowded_places_are_asked_once(spark, monkeypatch):
    """300 points at each of three places, 4 keys to a row: all pairs, and no place is measured twice."""
    monkeypatch.setattr(spatial, "TOGETHER", 4)
    rects = [(i, float(i % 5), 0.0, float(i % 5 + 3), float(2 + i % 40)) for i in range(60)]
    points = [(i, (1.0, 3.0, 500.0)[i % 3], 1.0) for i in range(900)]
    r = spark.createDataFrame(rects, "id long, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame(points, "point long, x double, y double")
    found = spatial.query_points(r, p, 4.0)
    assert sorted(map(tuple, found.collect())) == sorted((q, i) for q, x, y in points for i, x0, y0, x1, y1 in rects if x0 <= x <= x1 and y0 <= y <= y1)
    assert in_parts(found) > 1
    windows = p.selectExpr("point query", "x x0", "y y0", "x + 1 x1", "y + 1 y1")
    assert sorted(map(tuple, spatial.query_rects(r, windows, 4.0).collect())) == sorted((q, i) for q, x, y in points for i, x0, y0, x1, y1 in rects if x0 <= x + 1 and x <= x1 and y0 <= y + 1 and y <= y1)
    written, settle = [], spatial.settle
    monkeypatch.setattr(spatial, "settle", lambda df: counted(settle(df)))

    def counted(table):
        written.append((table.columns, table.count()))
        return table

    wires = r.selectExpr("id wire", "'Call' kind", "x0 ax", "y0 ay", "x1 bx", "y1 by")
    assert spatial.nearest_k(wires, p, 2, ["Call"]).count() == 1800
    assert [n for columns, n in written if "x" in columns and n > 3] == [900]
    near = spatial.nearest_wires(wires, p, 40.0, ["Call"]).collect()
    assert {r["point"] for r in near} == {q for q, x, _ in points if x < 500}


def test_sizes_past_the_longs(spark, tmp_path):
    spark.createDataFrame([(1, 7, 1_200_000, 60_000), (1, 1, 3, 2)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["l_partkey"] if "l_partkey" in r else r["l_linenumber"]: (r["n"], r["size"], r["grouped"]) for r in scalars.human_bytes_fmt(spark, str(tmp_path)).collect()}
    assert got == {1: (18000, "17.6 KB", "18,000"), 7: (None, f"{604_800_000_000_000_000_000 / 2**40:.1f} TB", "604,800,000,000,000,000,000")}


def test_clocks_past_the_year_9999(spark):
    at = spark.createDataFrame([(0,), (-1,), (253_402_300_800_000,), (253_402_300_800_000 + 3000 * text.SPAN_MS,)], "ms long")
    assert [r[0] for r in at.select(text.clock_text(F.col("ms"), 0)).collect()] == ["1970-01-01 00:00", "1969-12-31 23:59", "10000-01-01 00:00", "1210000-01-01 00:00"]


def test_slow_rows_are_dealt_out(spark):
    """Small tables of one partition: files, routers and texts with pointers are worked on by several tasks."""
    files = spark.createDataFrame([(f"p{i}.rs", f"fn f{i}() {{}}\n") for i in range(60)], "path string, text string").coalesce(1)
    assert in_parts(extract.items(files)) > 1
    code = "fn app() -> Router { Router::new().route(\"/a\", get(h)) }\n"
    crates = spark.createDataFrame([(f"k{i}", "src/main.rs", code) for i in range(60)], "crate string, path string, text string").coalesce(1)
    assert in_parts(routers.evaluate(crates)) > 1
    texts = spark.createDataFrame([(i, f'{{"a": {i}}}', "/a") for i in range(60)], "id long, text string, pointer string").coalesce(1)
    assert in_parts(routes.pointer_lines(texts)) > 1
