"""Loops that run on the driver over DataFrames: writing a step's state keeps plans short and survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for a local master without one."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(where)
    return where


def _remove(spark: SparkSession, top: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has already gone
        pass


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    top = f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}"
    if top not in _made:
        _made.add(top)
        atexit.register(_remove, spark, top)
    return f"{top}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "state") -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, its plan is a scan, and it survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*states: DataFrame) -> None:
    """Removes tables that ``written`` made and nothing reads any more, such as a loop's superseded states."""
    for df in states:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if f"/graphloom-{df.sparkSession.sparkContext.applicationId}/" in folder:
                _remove(df.sparkSession, folder)
