"""Positions and running sums over a whole table, by ranges: no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.storage import drop_settled, settle

#: Rows of a range, about, that one task sorts.
RANGE_ROWS = 1 << 18


def running(rows: DataFrame, *order: Column | str, sums: tuple[str, ...] = ()) -> DataFrame:
    """rows with before, the number of rows before each in the order, and before_<c>, the sum of c over these.

    Ranges of the order are numbered on their own and start where the ranges before them end; the only window over
    everything has a row a range. Equal rows get places in any order.
    """
    whole = settle(rows)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole.count() // RANGE_ROWS))
    held = settle(whole.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    drop_settled(whole)
    counts = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_n_{c}") for c in sums))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", *(f"_n_{c}" for c in sums))))
    inside = Window.partitionBy("_range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    told = {"before": F.row_number().over(inside) - 1} | {f"before_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in sums}
    placed = held.repartition(n, "_range").withColumns(told).join(starts, "_range")
    return placed.withColumns({"before": (F.col("before") + F.col("_n")).cast("long")} | {f"before_{c}": F.col(f"before_{c}") + F.col(f"_n_{c}") for c in sums}).select(*rows.columns, "before", *(f"before_{c}" for c in sums))


def numbered(rows: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """rows with place, each one's number from 0 inside its group in the order; a group with most rows lies in many ranges.

    Ranges of (group, order) are numbered on their own; what is added is a row a range and group. Equal rows get places in
    any order; a null group is a group.
    """
    held = settle(rows.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()))
    counts = settle(held.groupBy("_range", group).agg(F.count(F.lit(1)).alias("_n")))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_range").alias("_r"), F.col(group).alias("_g"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
    inside = held.withColumn("place", F.row_number().over(Window.partitionBy("_range", group).orderBy(*order)) - 1)
    placed = inside.join(starts, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return placed.withColumn("place", (F.col("place") + F.col("_n")).cast("long")).select(*rows.columns, "place")
