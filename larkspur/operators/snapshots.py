"""Graph snapshots: nodes and edges stored under the key of what they were made from, and read only if whole."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("namespace", "source", "adapter", "projection_signature", "source_signature", "schema_version")


def place(root: str, key: dict[str, str]) -> str:
    """The folder of a key; all of its parts are needed."""
    if set(key) != set(KEY):
        raise ValueError(f"a key has {KEY}")
    return f"{root.rstrip('/')}/{hashlib.sha256(chr(0).join(key[k] for k in KEY).encode()).hexdigest()}"


def digest(df: DataFrame) -> DataFrame:
    """(n, digest) of a table, whatever the order of its rows: row digests are summed by their parts, so no task holds
    them all."""
    d = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring(d, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"d{k}") for k in range(8)]
    summed = df.agg(F.count(F.lit(1)).alias("n"), *parts)
    return summed.select("n", F.sha2(F.concat_ws(",", *[F.coalesce(F.col(f"d{k}").cast("string"), F.lit("")) for k in range(8)]), 256).alias("digest"))


def put(nodes: DataFrame, edges: DataFrame, root: str, key: dict[str, str]) -> str:
    """Replaces what is stored under the key. The manifest, with count and digest of each table, comes last: a snapshot
    without it is none."""
    spark, where = nodes.sparkSession, place(root, key)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    manifest = None
    for name, t in (("nodes", nodes), ("edges", edges)):
        t.write.parquet(f"{where}/{name}")
        row = digest(spark.read.parquet(f"{where}/{name}")).select(F.lit(name).alias("name"), "n", "digest")
        manifest = row if manifest is None else manifest.union(row)
    manifest.select("*", *[F.lit(key[k]).alias(k) for k in KEY]).coalesce(1).write.parquet(f"{where}/manifest")
    return where


def get(spark: SparkSession, root: str, key: dict[str, str]) -> tuple[DataFrame, DataFrame] | None:
    """Nodes and edges stored under the key; None if there are none, or if a count or digest differs."""
    where = place(root, key)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    told = {r["name"]: r for r in spark.read.parquet(f"{where}/manifest").collect()}
    found = []
    for name in ("nodes", "edges"):
        r = told.get(name)
        if r is None or any(r[k] != key[k] for k in KEY):
            return None
        t = spark.read.parquet(f"{where}/{name}")
        if tuple(digest(t).first()) != (r["n"], r["digest"]):
            return None
        found.append(t)
    return found[0], found[1]
