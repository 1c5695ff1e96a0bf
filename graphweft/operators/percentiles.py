"""Exact percentiles of all groups at once, by histograms that close in on each rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.operators.spread import join_spread
from graphweft.storage import drop_settled, settle

#: Bins of a round's histogram, for each group and share.
BINS = 1024


def _bin(value: Column, low: Column, high: Column) -> Column:
    """The bin of value between low and high, never falling as value rises."""
    share = (value - low) / (high - low)
    return F.when(high > low, F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(0).cast("int")


def _scaled(value: Column) -> Column:
    """Rises with value, by its order of magnitude: the first round's bins hold numbers of any size apart."""
    return F.signum(value) * F.log1p(F.abs(value) * 1e9)


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, one double for each of shares): the least value that at least that share of the group's values doesn't exceed.

    A round counts, for every group and share, the values between two bounds by bins, combined before the shuffle, and
    goes on in the bin that holds the rank, from the least to the greatest value there, until these are one: no task or
    driver holds more than bins, however many values a group has. Bounds come to a group of over a task's worth of rows by
    broadcast. Nulls and NaN are left out; a null group is a group; a group without values gives nothing.
    """
    kept = settle(rows.select(F.struct(F.col(group).alias("g")).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)"))
    sizes = kept.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranks = [F.struct(F.lit(name).alias("share"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share).cast("decimal(18,9)"))).cast("long").alias("rank"), "low", "high") for name, share in shares.items()]
    state = settle(sizes.select("k", F.inline(F.array(*ranks))))
    found, first = state.where("low = high").select("k", "share", F.col("low").alias("v")), True
    left = state.where("low < high")
    while not left.isEmpty():
        bounds = left.groupBy("k").agg(F.collect_list(F.struct("share", "rank", "low", "high")).alias("open"))
        met = join_spread(kept, settle(bounds), "k", "inner").select("k", "v", F.inline("open")).where("v between low and high")
        scaled = _scaled if first else (lambda c: c)
        binned = met.groupBy("k", "share", "rank", _bin(scaled(F.col("v")), scaled(F.col("low")), scaled(F.col("high"))).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("k", "share").orderBy("bin"))
        at = binned.withColumn("upto", upto).where("upto >= rank and upto - n < rank")
        state = settle(at.select("k", "share", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "low", "high"))
        found, left, first = found.unionByName(state.where("low = high").select("k", "share", F.col("low").alias("v"))), state.where("low < high"), False
    out = settle(found)
    drop_settled(kept)
    return out.groupBy("k").agg(*(F.max(F.when(F.col("share") == name, F.col("v"))).alias(name) for name in shares)).select(F.col("k.g").alias(group), *shares)
