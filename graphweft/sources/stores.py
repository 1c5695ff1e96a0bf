"""Sinks: tables kept under a version and a key, atomic files, and edits that are checked before they are written."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _runs(spark: SparkSession, path: str) -> list[str]:
    """Folders of whole writes below path, newest first: those whose commit left its mark."""
    files, at = _files(spark, path)
    if not files.exists(at):
        return []
    marks = [(files.getFileStatus(m).getModificationTime(), f.getPath().toString()) for f in files.listStatus(at) if files.exists(m := spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return [p for _, p in sorted(marks, reverse=True)]


def save(df: DataFrame, folder: str, name: str, version: int, key: int) -> str:
    """Writes df under its name, version and key, into a folder of its own each time: readers see the last whole write.

    The write before the last stays for those that still read it; older ones go.
    """
    spark, path = df.sparkSession, f"{folder}/name={name}/version={version}/key={key}"
    earlier = _runs(spark, path)
    df.write.parquet(f"{path}/write={uuid.uuid4().hex}")
    for old in earlier[1:]:
        files, at = _files(spark, old)
        files.delete(at, True)
    return path


def load(spark: SparkSession, folder: str, name: str, version: int, key: int) -> DataFrame | None:
    """What was saved last under exactly these, or None: another version or key is a miss, and so is a broken table."""
    runs = _runs(spark, f"{folder}/name={name}/version={version}/key={key}")
    if not runs:
        return None
    try:
        found = spark.read.parquet(runs[0])
        found.limit(1).collect()
        return found
    except Exception as e:  # noqa: BLE001  a cache that can't be read is a miss
        if isinstance(e, (AnalysisException, OSError)) or "parquet" in str(e).lower():
            return None
        raise


def save_graph(tables: dict[str, DataFrame], folder: str, version: int, fingerprint: int) -> None:
    for name, df in tables.items():
        save(df, folder, name, version, fingerprint)


def load_graph(spark: SparkSession, names: list[str], folder: str, version: int, fingerprint: int) -> dict[str, DataFrame] | None:
    """All tables of a graph, or None if any is missing."""
    found = {n: load(spark, folder, n, version, fingerprint) for n in names}
    return None if any(x is None for x in found.values()) else found


def atomic_write(path: str, content: bytes) -> None:
    """A file in place of another, with its permissions; readers see the old or the new one."""
    descriptor, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(descriptor, "wb") as f:
            f.write(content)
        if os.path.exists(path):
            shutil.copymode(path, temporary)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def refreshed(table: DataFrame, fresh: DataFrame, paths: list[str]) -> DataFrame:
    """table with the rows of some files replaced: what a saved edit changes."""
    return table.where(~F.col("path").isin(*paths)).unionByName(fresh.where(F.col("path").isin(*paths)))


def unproven(edges: DataFrame) -> DataFrame:
    """Edges of a file parsed again: name matches, whatever the whole analysis had proven before."""
    return edges.withColumns({"tier": F.lit("Unresolved"), "basis": F.lit("NameMatch")})


def report(tables: dict[str, DataFrame]) -> list[tuple[str, int, float]]:
    """(table, rows, seconds) of each table, counted."""
    import time

    out = []
    for name, df in tables.items():
        began = time.time()
        out.append((name, df.count(), time.time() - began))
    return out
