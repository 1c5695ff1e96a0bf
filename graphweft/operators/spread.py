"""Joins on keys of which one may have a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that one task may get. Of a table of N rows, N / KEY_ROWS keys at most have more.
KEY_ROWS = 1 << 20


def tasks(spark: SparkSession) -> int:
    """How many tasks work that is slow by row is dealt to: small rows would otherwise be put together until one task has them all."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def joined(rows: DataFrame, table: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """rows joined to table where both are shuffled: a table below the broadcast threshold would pass through the driver, in loops again each round."""
    return rows.join(table.hint("merge"), on, how)


def join_spread(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows joined (left or inner) to table, which has one row a key at most.

    Rows of a key with over KEY_ROWS rows stay where they are and get the table's row by broadcast: there are few such
    keys, whatever the table. The others meet in a shuffle. Both are read several times: they should be written tables.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > KEY_ROWS)
    heavy = counts.select(key) if rows.count() > KEY_ROWS else None
    if heavy is None or heavy.isEmpty():
        return rows.join(table, key, how)
    often = table.join(F.broadcast(heavy), key)
    seldom = rows.join(F.broadcast(heavy), key, "left_anti").join(table, key, how)
    return rows.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(often), key, how).unionByName(seldom)
