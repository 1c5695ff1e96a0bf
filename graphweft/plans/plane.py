"""Queries over rectangles and wires in the plane."""

from pyspark.sql import functions as F

from graphweft.operators import spatial as S
from graphweft.operators.percentiles import percentiles
from graphweft.plans.adapters import adapted
from graphweft.plans.registry import query

WINDOWS = "SELECT s_suppkey AS query, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS x0, CAST(s_suppkey * 53 % 1900 AS DOUBLE) AS y0, CAST(s_suppkey * 37 % 1000 + 60 AS DOUBLE) AS x1, CAST(s_suppkey * 53 % 1900 + 80 AS DOUBLE) AS y1 FROM supplier"
POINTS = "SELECT c_custkey AS point, CAST(c_custkey * 37 % 1100 AS DOUBLE) AS x, CAST(c_custkey * 53 % 2000 AS DOUBLE) AS y FROM customer"


def _points(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey point", "double(c_custkey * 37 % 1100) x", "double(c_custkey * 53 % 2000) y")


@query("SELECT id, CAST((floor(x1 / 64) - floor(x0 / 64) + 1) * (floor(y1 / 64) - floor(y0 / 64) + 1) AS BIGINT) AS cells FROM rects", "rects")
def grid_cells(spark, sf):
    return S.gridded(adapted(spark, sf, "rects"), 64.0).groupBy("id").agg(F.count(F.lit(1)).alias("cells"))


@query(f"SELECT q.query, r.id FROM ({WINDOWS}) q JOIN rects r ON r.x0 <= q.x1 AND q.x0 <= r.x1 AND r.y0 <= q.y1 AND q.y0 <= r.y1", "rects")
def grid_rect_query(spark, sf):
    q = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey query", "double(s_suppkey * 37 % 1000) x0", "double(s_suppkey * 53 % 1900) y0", "double(s_suppkey * 37 % 1000 + 60) x1", "double(s_suppkey * 53 % 1900 + 80) y1")
    return S.query_rects(adapted(spark, sf, "rects"), q, 64.0)


@query(f"SELECT p.point, r.id FROM ({POINTS}) p JOIN rects r ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1", "rects")
def grid_point_query(spark, sf):
    return S.query_points(adapted(spark, sf, "rects"), _points(spark, sf), 64.0)


@query("SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM rects", "rects")
def world_bounds(spark, sf):
    return S.bounds(adapted(spark, sf, "rects"))


@query("SELECT CAST(floor((x0 + x1) / 2 / 256) AS BIGINT) AS tx, CAST(floor((y0 + y1) / 2 / 256) AS BIGINT) AS ty, CAST(count(*) AS BIGINT) AS wires FROM rects GROUP BY 1, 2", "rects")
def tile_groups(spark, sf):
    return S.tiles(adapted(spark, sf, "rects").selectExpr("x0 ax", "y0 ay", "x1 bx", "y1 by"), 256.0)


SEGMENT = "round(sqrt(power(x - x0 - t * (x1 - x0), 2) + power(y - y0 - t * (y1 - y0), 2)), 9)"
SHARE = "CASE WHEN (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) > 0 THEN greatest(0.0, least(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) ELSE 0.0 END"


@query(
    f"""WITH met AS (SELECT point, id, {SEGMENT} AS d FROM (SELECT *, {SHARE} AS t FROM ({POINTS}) p, rects WHERE id % 3 > 0 AND x >= x0 - 40 AND x <= x1 + 40 AND y >= y0 - 40 AND y <= y1 + 40) m),
    best AS (SELECT point, min(d) AS distance FROM met WHERE d <= 40 GROUP BY point)
    SELECT b.point, min(m.id) AS wire, round(b.distance, 6) AS distance FROM best b JOIN met m ON m.point = b.point AND m.d = b.distance GROUP BY b.point, b.distance""",
    "rects",
)
def nearest_wire(spark, sf):
    wires = adapted(spark, sf, "rects").selectExpr("id wire", "case id % 3 when 0 then 'Asset' else 'Call' end kind", "x0 ax", "y0 ay", "x1 bx", "y1 by")
    return S.nearest_wires(wires, _points(spark, sf), 40.0, ["Call", "Import"]).withColumn("distance", F.round("distance", 6))


@query(
    f"""WITH met AS (SELECT point, id AS wire, round({SEGMENT}, 9) AS d FROM (SELECT *, {SHARE} AS t FROM ({POINTS}) p, rects WHERE id % 3 > 0) m),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY d, wire) AS rank FROM met)
    SELECT point, CAST(rank AS INT) AS rank, round(d, 6) AS distance FROM ranked WHERE rank <= 3""",
    "rects",
)
def nearest_three_wires(spark, sf):
    """Distances by rank: ties to the last digits may fall to another wire in another engine."""
    wires = adapted(spark, sf, "rects").selectExpr("id wire", "case id % 3 when 0 then 'Asset' else 'Call' end kind", "x0 ax", "y0 ay", "x1 bx", "y1 by")
    return S.nearest_k(wires, _points(spark, sf), 3, ["Call"]).select("point", "rank", F.round("distance", 6).alias("distance"))


@query(
    """SELECT id, round((SELECT min(sqrt(power(0.0 - (power(1 - i / 24.0, 3) * x0 + 3 * power(1 - i / 24.0, 2) * (i / 24.0) * x1 + 3 * (1 - i / 24.0) * power(i / 24.0, 2) * x0 + power(i / 24.0, 3) * x1), 2)
      + power(0.0 - (power(1 - i / 24.0, 3) * y0 + 3 * power(1 - i / 24.0, 2) * (i / 24.0) * y0 + 3 * (1 - i / 24.0) * power(i / 24.0, 2) * y1 + power(i / 24.0, 3) * y1), 2))) FROM range(0, 25) t(i)), 6) AS distance FROM rects""",
    "rects",
)
def curve_distance(spark, sf):
    c = F.col
    d = S.bezier_distance(F.lit(0.0), F.lit(0.0), [(c("x0"), c("y0")), (c("x1"), c("y0")), (c("x0"), c("y1")), (c("x1"), c("y1"))])
    return adapted(spark, sf, "rects").select("id", F.round(d, 6).alias("distance"))


@query()
def treemap(spark, sf):
    """An ordered fold: tested on areas and overlaps."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    return S.treemap(p.selectExpr("p_brand grp", "p_partkey idx", "p_size size"))


@query()
def column_packing(spark, sf):
    """An ordered fold: tested against a brute-force version."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    return S.packed_columns(p.selectExpr("p_brand grp", "p_partkey idx", "double(20) width", "double(p_size) height"))


@query("SELECT event_type, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95, CAST(quantile_disc(value, 0.99) AS DOUBLE) AS p99, max(value) AS worst FROM events GROUP BY event_type")
def percentile_nearest_rank(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    ranks = percentiles(e, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return ranks.join(e.groupBy("event_type").agg(F.max("value").alias("worst")), "event_type")
