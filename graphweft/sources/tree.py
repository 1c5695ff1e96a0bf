"""The recursive tree scan: folders are listed level by level on executors, every entry kept."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.operators.graph import settle
from graphweft.operators.paths import CACHEDIR_SIGNATURE, HEAVY_MARKERS, VCS_FOLDERS

#: Images by extension, the largest text that is parsed, and how much of a file is looked at.
IMAGES = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "ico", "svg", "tga")
MAX_PARSE_BYTES, HEAD_BYTES = 1_500_000, 8192
ENTRY = "path string, type string, size long, blocks long, dev long, ino long, mtime_ns long, head binary, error string, heavy string"


def file_kind(path: Column, size: Column, head: Column, error: Column) -> Column:
    """Unreadable, Image by extension, TooLarge, Binary by a zero byte in the head, or Text, in that order."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(error.isNotNull(), "Unreadable").when(extension.isin(*IMAGES), "Image").when(size > MAX_PARSE_BYTES, "TooLarge").when(F.contains(head, F.unhex(F.lit("00"))), "Binary").otherwise("Text")


def _listing(root: str, ignored: frozenset[str], descend_heavy: frozenset[str]):
    def heavy(rel: str, names: list[str]) -> str | None:
        if rel in descend_heavy:
            return None
        if rel.rsplit("/", 1)[-1] in VCS_FOLDERS:
            return "version control"
        if rel + "/" in ignored:
            return "ignored"
        for mark, reason in HEAVY_MARKERS.items():
            if mark in names:
                if mark == "CACHEDIR.TAG":
                    with open(os.path.join(root, rel, mark), "rb") as f:
                        if not f.read(len(CACHEDIR_SIGNATURE)).startswith(CACHEDIR_SIGNATURE.encode()):
                            continue
                return reason
        return None

    def look(rel: str) -> tuple:
        full = os.path.join(root, rel)
        try:
            s = os.lstat(full)
        except OSError as e:
            return (rel, "file", 0, 0, 0, 0, 0, None, str(e.strerror), None)
        common = (s.st_size, s.st_blocks, s.st_dev, s.st_ino, s.st_mtime_ns)
        if stat.S_ISLNK(s.st_mode):
            return (rel, "link", *common, None, None, None)
        if stat.S_ISDIR(s.st_mode):
            try:
                return (rel, "dir", *common, None, None, heavy(rel, os.listdir(full)))
            except OSError as e:
                return (rel, "dir", *common, None, str(e.strerror), None)
        try:
            with open(full, "rb") as f:
                return (rel, "file", *common, f.read(HEAD_BYTES), None, None)
        except OSError as e:
            return (rel, "file", *common, None, str(e.strerror), None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRY.split(", ")]
        for pdf in frames:
            rows = []
            for folder in pdf["path"]:
                for name in sorted(os.listdir(os.path.join(root, folder))):
                    rows.append(look(f"{folder}/{name}" if folder else name))
            yield pd.DataFrame(rows, columns=names)

    return run


def scan_tree(spark: SparkSession, root: str, ignored: list[str] = (), inside: str = "", descend_heavy: list[str] = ()) -> DataFrame:
    """(path, type, size, ..., kind) of every entry below root (or below its folder inside), links not followed.

    Heavy folders are listed with their reason and not descended, but for those in descend_heavy. root must be on a
    file system that executors share. One round a level: a folder is one row, so a wide tree is many tasks.
    """
    level = spark.createDataFrame([(inside,)], "path string")
    list_ = _listing(root, frozenset(ignored), frozenset(descend_heavy))
    found = None
    while True:
        rows = settle(level.mapInPandas(list_, ENTRY))
        found = rows if found is None else found.unionAll(rows)
        level = rows.where("type = 'dir' and heavy is null and error is null").select("path")
        if level.isEmpty():
            break
        level = level.repartition(spark.sparkContext.defaultParallelism)
    kind = F.when(F.col("type") == "file", file_kind(F.col("path"), F.col("size"), F.col("head"), F.col("error"))).when(F.col("type") == "link", "Symlink")
    return found.withColumn("kind", kind)


def load_folder(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """The subtree of one heavy folder, on demand."""
    return scan_tree(spark, root, inside=folder, descend_heavy=[folder])


def disk_usage(entries: DataFrame) -> DataFrame:
    """(bytes): allocated blocks, each hard link once, on the first entry's file system."""
    first = entries.agg(F.min_by("dev", "path").alias("own"))
    once = entries.groupBy("dev", "ino").agg(F.max("blocks").alias("blocks"))
    return once.join(F.broadcast(first), F.col("dev") == F.col("own")).agg(F.coalesce(F.sum(F.col("blocks") * 512), F.lit(0)).alias("bytes"))


def tree_fingerprint(entries: DataFrame) -> int:
    """One number for paths, sizes and times of all entries; order doesn't count."""
    return entries.select(F.xxhash64("path", "size", "mtime_ns").alias("h")).agg(F.bit_xor("h"), F.count(F.lit(1))).select(F.xxhash64("bit_xor(h)", "count(1)")).first()[0]


def texts(entries: DataFrame, root: str) -> DataFrame:
    """(path, text) of the text files of a scan, hidden ones too (Spark's own file readers pass those over); read on executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path in pdf["path"]:
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        yield pd.DataFrame({"path": [path], "text": [f.read().decode("utf-8", "replace")]})
                except OSError:  # it went meanwhile
                    continue

    return entries.where("kind = 'Text'").select("path").mapInPandas(run, "path string, text string")
