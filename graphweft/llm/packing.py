"""Best-fit packing of documents into bins, with conflicts between documents of one source or one group of near copies."""

from __future__ import annotations

from bisect import insort
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.common import join_spread, settle
from graphweft.llm.near_copies import hashed, near_copy_groups

#: Words a bin holds, and documents packed together.
CAPACITY, SHARD_ROWS = 2048, 4096
#: Repetitions of one row made by one task.
REPEATS = 4096


class Bins:
    """Open bins in order of residual, each with bitmaps of the sources and groups of copies that it holds."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.number = capacity, 0
        self.levels: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # (number, sources, groups), oldest first
        self.shared = [0] * (capacity + 1)  # sources that all bins of a level hold
        self.open = 0  # bit r: there is a bin with residual r
        self.closed: dict[int, int] = {}  # by source bit: levels all of whose bins hold it

    def place(self, size: int, source: int, group: int) -> tuple[int, int]:
        """(bin, offset) for an item whose bits are source and group: the tightest compatible bin, the oldest of equals."""
        rest = (self.open & ~self.closed.get(source, 0)) >> size << size
        while rest:
            residual = (rest & -rest).bit_length() - 1
            level = self.levels[residual]
            for i, (number, sources, groups) in enumerate(level):
                if not sources & source and not groups & group:
                    del level[i]
                    self._changed(residual)
                    self._put(residual - size, number, sources | source, groups | group)
                    return number, self.capacity - residual
            rest &= rest - 1  # the successor: the next larger residual
        number, self.number = self.number, self.number + 1
        self._put(self.capacity - size, number, source, group)
        return number, 0

    def _put(self, residual: int, number: int, sources: int, groups: int) -> None:
        insort(self.levels[residual], (number, sources, groups))
        self._changed(residual)

    def _changed(self, residual: int) -> None:
        level, bit = self.levels[residual], 1 << residual
        shared = reduce(and_, (b[1] for b in level)) if level else 0
        self.open = self.open | bit if level else self.open & ~bit
        differ, self.shared[residual] = shared ^ self.shared[residual], shared
        while differ:
            source = differ & -differ
            self.closed[source] = self.closed.get(source, 0) ^ bit
            differ ^= source


def _packer(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values(["rest", "doc_id", "grp", "key", "size", "copy"], ascending=[False] + [True] * 5, ignore_index=True, na_position="last")
        sources = {k: 1 << i for i, k in enumerate(sorted(set(pdf["key"])))}
        often = pdf["grp"].value_counts()
        groups = {g: 1 << i for i, g in enumerate(sorted(often[often > 1].index))}  # who is alone conflicts with nobody
        bins, numbers, offsets = Bins(capacity), [], []
        for rest, key, group in zip(pdf["rest"].tolist(), pdf["key"].tolist(), pdf["grp"].tolist(), strict=True):
            number, offset = bins.place(rest, sources[key], groups.get(group, 0)) if rest else (None, None)
            numbers.append(number)
            offsets.append(offset)
        out, full = [], bins.number
        columns = zip(pdf["doc_id"], pdf["copy"], pdf["source"], pdf["grp"], pdf["size"].tolist(), pdf["rest"].tolist(), numbers, offsets, strict=True)
        for doc_id, copy, source, group, size, rest, number, offset in columns:
            for piece, start in enumerate(range(0, size - rest, capacity)):  # full bins of long documents
                out.append((doc_id, copy, piece, start, capacity, (shard << 32) | full, 0, source, group))
                full += 1
            if rest:
                out.append((doc_id, copy, (size - rest) // capacity, size - rest, rest, (shard << 32) | number, offset, source, group))
            elif not size:
                out.append((doc_id, copy, 0, 0, 0, None, None, source, group))
        names = ["doc_id", "copy", "piece", "start_word", "n_words", "bin_id", "bin_offset", "source", "group_id"]
        return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("doc_id", "copy", "piece", "start_word", "n_words", "bin_id", "bin_offset", "group_id")})

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, copy, piece, start_word, n_words, bin_id, bin_offset, source, group_id): where each document's words go.

    Documents of one source never share a bin, nor do near copies (near_copies: five-word shingles at 0.8, over all
    rows); group_id names their group. A document longer than capacity fills bins of its own; what is left of it is
    packed. Documents are dealt by a hash of id and text into shards of about shard_rows, each packed on its own, longest
    first: a hot source or group of copies is spread evenly, and a shard's memory is bounded. Texts move only where they
    may have near copies. bin_id: shard * 2**32 + number.

    Null and empty texts come back with no bin; a null source is a source; repeated rows (and null ids) are documents of
    their own, told apart by copy; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "source", F.xxhash64("text").alias("xh"), "text")
    read = settle(rows.mapInArrow(hashed, "doc_id long, source string, xh long, text_hash long, size long, bands array<long>, mark binary"))
    clusters = near_copy_groups(read.withColumnRenamed("text_hash", "grp"), rows.select("xh", "text")).withColumnRenamed("grp", "text_hash")
    items = settle(read.groupBy("doc_id", "source", "size", "text_hash").agg(F.count(F.lit(1)).alias("copies")))
    named = settle(items.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).join(clusters, "text_hash", "left"))
    items = join_spread(items, named, "text_hash")  # a text may have a third of all ids
    items = items.withColumn("key", F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))).withColumn("grp", F.coalesce("cluster", "text_hash"))
    before = Window.partitionBy("doc_id", "grp").orderBy("size", "key", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    items = settle(items.withColumn("first", F.coalesce(F.sum("copies").over(before), F.lit(0)) + 1).drop("cluster"))
    total = items.agg(F.sum("copies")).first()[0] or 0
    # Many copies of one row are told apart in two steps, so that no task makes them all.
    some = items.withColumn("from", F.explode(F.expr(f"sequence(first, first + copies - 1, {REPEATS})"))).repartition("doc_id", "text_hash", "from")
    single = some.withColumn("copy", F.explode(F.expr(f"sequence(`from`, least(`from` + {REPEATS}, first + copies) - 1)")))
    shard = F.pmod(F.xxhash64("doc_id", "text_hash", "copy"), F.lit(max(1, -(-total // shard_rows))))
    sharded = single.select("doc_id", F.col("copy").cast("long").alias("copy"), "source", "key", "grp", "size", (F.col("size") % capacity).alias("rest"), shard.cast("long").alias("shard"))
    return sharded.groupBy("shard").applyInPandas(_packer(capacity), "doc_id long, copy long, piece long, start_word long, n_words long, bin_id long, bin_offset long, source string, group_id long")
