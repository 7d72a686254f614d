"""Exact cosine retrieval over chunk vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.lexical import role_rank


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def sound(chunks: DataFrame, dimension: int | None = None) -> DataFrame:
    """Chunks whose vector is finite, of the dimension, and not zero."""
    v = F.col("embedding")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return chunks.where(good if dimension is None else good & (F.size(v) == dimension)).where(F.exists(v, lambda x: x != 0))


def scores(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, chunk columns, score): every chunk against each of the query vectors (query_id, vector), which are the
    query set."""
    c = sound(chunks).withColumn("__v", doubles(F.col("embedding"))).withColumn("__n", norm(F.col("__v"))).drop("embedding")
    q = vectors.select("query_id", doubles(F.col("vector")).alias("__q")).withColumn("__qn", norm(F.col("__q"))).where("__qn > 0")
    return c.join(F.broadcast(q)).withColumn("score", dot(F.col("__v"), F.col("__q")) / (F.col("__n") * F.col("__qn"))).drop("__v", "__n", "__q", "__qn")


def best_chunks(scored: DataFrame) -> DataFrame:
    """The best chunk of each page and query, the lowest ordinal of equals."""
    best = F.max(F.struct("score", (-F.col("ordinal")).alias("o"))).alias("b")
    return scored.groupBy("query_id", "page_id").agg(best).select("query_id", "page_id", F.col("b.score").alias("score"), (-F.col("b.o")).alias("ordinal"))


def top_pages(best: DataFrame, pages: DataFrame, limit: int = 8, *more: str) -> DataFrame:
    """(query_id, page_id, path, role, score, rank, more) by unrounded score, role, path, id."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), role_rank(F.col("role")), "path", "page_id", "ordinal")
    placed = best.join(pages.select("page_id", "path", "role"), "page_id")
    return placed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "page_id", "path", "role", "score", "rank", *more)


#: By how much a score of whole matrices may be off the one that counts.
SLACK = 1e-9


def nearest(chunks: DataFrame, vectors: DataFrame, pages: DataFrame, limit: int = 8) -> DataFrame:
    """top_pages of the best chunks of chunks (page_id, ordinal, embedding) for the query vectors (query_id, vector),
    which are the query set and go to every task. Each batch of chunks lets only rows out that can be among a query's
    first pages; only these are scored in the order that counts, and shuffled."""
    asked = sound(vectors.select("query_id", F.col("vector").alias("embedding"))).withColumnRenamed("embedding", "vector")
    held = [(r["query_id"], len(r["vector"]), r["vector"]) for r in asked.collect()]
    there = sound(chunks).select("page_id", "ordinal", "embedding").join(pages.select("page_id"), "page_id", "left_semi")
    schema = T.StructType([*there.schema.fields, T.StructField("asked", T.ArrayType(T.LongType()))])
    near = there.mapInArrow(_near(held, limit), schema)
    each = near.select("page_id", "ordinal", "embedding", F.explode("asked").alias("query_id")).withColumn("__v", doubles(F.col("embedding")))
    q = asked.select("query_id", doubles(F.col("vector")).alias("__q"))
    scored = each.join(F.broadcast(q), "query_id").select("query_id", "page_id", "ordinal", (dot(F.col("__v"), F.col("__q")) / (norm(F.col("__v")) * norm(F.col("__q")))).alias("score"))
    return top_pages(best_chunks(scored), pages, limit)


def _near(held: list[tuple], limit: int) -> Callable:
    ids = np.array([h[0] for h in held], dtype=np.int64)
    matrix = np.array([h[2] for h in held], dtype=np.float64) if len({h[1] for h in held}) == 1 else None
    unit = None if matrix is None else matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, n = b.column(2), b.num_rows
            sizes = set(pc.list_value_length(vectors).to_pylist())
            if unit is None or sizes != {unit.shape[1]}:
                # vectors of differing length are left to the scores that count
                mine = np.ones((n, len(ids)), dtype=bool)
            else:
                own = vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
                scores = own @ unit.T / np.sqrt(np.einsum("ij,ij->i", own, own))[:, None]
                page = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)[1]
                best = np.full((page.max(initial=-1) + 1, len(ids)), -np.inf)
                np.maximum.at(best, page, scores)
                least = np.partition(best, -limit, axis=0)[-limit] - SLACK if len(best) > limit else np.full(len(ids), -np.inf)
                mine = scores >= least
            some = mine.any(axis=1)
            asked = pa.array([ids[m] for m in mine[some]], pa.list_(pa.int64()))
            yield pa.record_batch([*(c.filter(pa.array(some)) for c in b.columns), asked], names=["page_id", "ordinal", "embedding", "asked"])

    return run
