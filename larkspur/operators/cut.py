"""Tables in the folder that driver and executors share: lineage cuts for loops, and tables kept between queries."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Without it a temporary folder serves a local session; a cluster has none that
    all its machines see, so there it is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", "")
    if not found and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found and sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="larkspur-")
    return (found or _OWN[sc.applicationId]).rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written and read again: lineage is cut, and the planner knows its true size."""
    path = f"{shared_dir(df.sparkSession)}/larkspur/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def signature(spark: SparkSession, *paths: str) -> str:
    """A digest of the files under the paths: names, sizes and times of change."""
    seen = []
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()}\t{f.getLen()}\t{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:32]
