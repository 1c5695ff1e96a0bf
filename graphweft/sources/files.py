"""Texts of files as a table, and readers that turn each text into rows on executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.operators.spread import tasks


def read_texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text) of files below root by Spark's binary reader, so any store that Spark reads will do."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root if "://" in root else f"file:{root}"
    cut = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    top = base.partition(":")[2].replace("//", "/") if "://" not in root else "/" + root.partition("://")[2]
    return rows.select(F.regexp_replace(cut, "^" + "".join(f"[{c}]" if c in ".+()*?" else c for c in top.rstrip("/")) + "/", "").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def parsed(files: DataFrame, reader: Callable[[str, str], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of reader(path, text) for all files (path, text). A reader that fails gives a row with an error and no other value.

    schema: columns of the rows; path stands before them and error after them.
    """
    names = [c.strip().split(" ")[0] for c in _split(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    rows += [(path, *r, None) for r in reader(path, text or "")]
                except Exception as e:  # noqa: BLE001  one bad file doesn't stop the others
                    rows.append((path, *[None] * len(names), (str(e).splitlines() or [type(e).__name__])[0]))
            yield pd.DataFrame(rows, columns=["path", *names, "error"], dtype=object)

    # Dealt out by path: a small table of many files is one partition, and a reader is slow.
    dealt = files.select("path", "text").repartition(tasks(files.sparkSession), "path")
    return dealt.mapInPandas(run, f"path string, {schema}, error string")


def _split(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
