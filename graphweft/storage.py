"""Tables written to the folder that driver and executors share, which cut lineage: a lost executor repeats one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, where it is set. Unset, a temporary folder in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graphweft-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/graphweft-loops"


#: Names of all folders given out here: nothing else is ever deleted.
_NAMES: set[str] = set()


def new_path(spark: SparkSession) -> str:
    name = uuid.uuid4().hex
    _NAMES.add(name)
    return f"{shared_folder(spark)}/{name}"


def settle(df: DataFrame) -> DataFrame:
    """df written and read again."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(*tables: DataFrame) -> None:
    """Delete tables that settle() wrote, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.rsplit("/", 1)[1] in _NAMES:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
