"""Shared helpers: written tables that cut lineage, word splitting, and column hygiene."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space. Fixed by the operators' contracts.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it is a temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graphweft-")
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/graphweft"


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later stages restart from files, not from its lineage."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    _NAMES.add(name)
    return spark.read.schema(df.schema).parquet(path)


#: Paths that settle() wrote and that weren't deleted yet.
_WRITTEN: list[str] = []
#: Names of all folders that settle() wrote: nothing else is ever deleted.
_NAMES: set[str] = set()


def settle_only(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, written; the tables that were written on the way to it are deleted."""
    before = len(_WRITTEN)
    out = settle(make())
    for path in _WRITTEN[before:-1]:
        _delete(out.sparkSession, path)
    del _WRITTEN[before:-1]
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_settled(*tables: DataFrame) -> None:
    """Delete tables that settle() wrote, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.rsplit("/", 1)[1] in _NAMES:
                _delete(spark, folder)


#: A key with more than a FREQUENT-th of all rows is frequent, and so is one with over MOST_ROWS: of N rows there are fewer
#: than FREQUENT + N / MOST_ROWS frequent keys.
FREQUENT, MOST_ROWS = 2048, 1 << 22
#: Cells of keys by hash that frequent() counts first; more of them if one would have many rows on average.
_CELLS = 1 << 16


def _limit(total: int) -> int:
    return min(total // FREQUENT, MOST_ROWS)


def frequent(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the frequent keys (longs) of rows, exactly; without a shuffle of the rows.

    Rows are counted by cells of keys first, then by key in the cells that may hold a frequent one: both counts are
    combined before the shuffle, and cells and keys of more than the limit only come to the driver.
    """
    total = rows.count()
    cell = F.pmod(F.xxhash64(key), F.lit(max(_CELLS, 16 * total // MOST_ROWS)))
    heavy = [r[0] for r in rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _limit(total)).collect()]
    found = rows.where(cell.isin(heavy)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _limit(total)).collect() if heavy else []
    return rows.sparkSession.createDataFrame([tuple(r) for r in found], f"{key} long, n long")


def join_spread(rows: DataFrame, table: DataFrame, key: str, n: str = "n", least: int = 0) -> DataFrame:
    """rows joined to table, which has one row a key and in n the number of rows with that key; n goes.

    Rows of frequent keys stay where they are and get the table's few rows for them by broadcast, so a key with a third
    of all rows is nobody's partition; the others meet in a shuffle. Keys with no more than least rows, which any task can
    hold, are never spread. Both are read twice: they should be written tables.
    """
    total, most = table.agg(F.sum(n), F.max(n)).first()
    limit = max(_limit(total or 0), least)
    if (most or 0) <= limit:
        return rows.join(table.drop(n), key)
    hot = F.col(n) > limit
    often, seldom = F.broadcast(table.where(hot)), table.where(~hot).drop(n)
    return rows.join(often, key).drop(n).unionByName(rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti").join(seldom, key))


def whole_runs(batches, width: int = 1) -> Iterator[pa.Table]:
    """Tables of sorted rows, cut so that no run of rows with equal first width columns is divided."""
    held: list[pa.RecordBatch] = []
    key = lambda b, row: tuple(b.column(c)[row] for c in range(width))
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        last, first, end = key(batch, n - 1), 0, n - 1  # by bisection: the first row of the last run
        while first < end:
            middle = (first + end) // 2
            first, end = (first, middle) if key(batch, middle) == last else (middle + 1, end)
        if first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
