"""Stored chunk vectors: matrix blocks with checksums, laid out by a hash of the page, searched block by block.

A store is a manifest (one row: identity, dimension, buckets, count) and blocks of at most ``BLOCK`` vectors each, in
folders by bucket of the page's hash. Every block carries the digest of its identity, its shape and the checksum of its
bytes and places. A manifest that differs is a miss; a block is checked when a task reads it, and one that does not hold
is left out of results and listed by ``bad_blocks``; ``repaired`` embeds the pages of such buckets again and writes
these buckets anew. ``search`` scores a block against the whole query set at once, in double precision, and lets
only the pages out that can be among a query's first ones. With candidates, the buckets that hold none are never read.

Defined results: chunks whose vector is null, of another length, zero or not finite are not stored; a store without
vectors finds nothing; a zero or null query vector finds nothing; equal scores are told apart by role, path and page.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import embedding, lexical, vector
from larkspur.operators.cut import cut

BLOCK, BUCKETS = 2048, 64
#: Of the tables; a store of another number is a miss.
VERSION = 1
_BLOCK = "bucket int, pages array<string>, ordinals array<int>, starts array<int>, ends array<int>, dimension int, matrix binary, identity string, checksum string"
_MANIFEST = "version int, identity string, dimension int, buckets int, vectors long"


def bucket_of(page_id, buckets: int):
    return F.pmod(F.xxhash64(page_id), F.lit(buckets)).cast("int")


def _checksum(identity: str, dimension: int, pages: list[str], ordinals: list[int], starts: list[int], ends: list[int], matrix: bytes) -> str:
    said = hashlib.sha256(struct.pack("<qq", dimension, len(pages)) + identity.encode())
    for p, o, s, e in zip(pages, ordinals, starts, ends, strict=True):
        said.update(struct.pack("<qqq", o, s, e) + hashlib.sha256(p.encode()).digest())
    said.update(matrix)
    return said.hexdigest()


def _blocks(identity: str, dimension: int) -> Callable:
    """Sorted rows of vectors to blocks; a block ends with its bucket."""
    names = ["bucket", "pages", "ordinals", "starts", "ends", "dimension", "matrix", "identity", "checksum"]
    kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.string(), pa.string()]

    def block(rows: list[tuple]) -> pa.RecordBatch:
        bucket, pages, ordinals, starts, ends, vectors = zip(*rows, strict=True)
        matrix = np.asarray(vectors, dtype="<f4").tobytes()
        own = [list(x) for x in (pages, ordinals, starts, ends)]
        values = [bucket[0], *own, dimension, matrix, identity, _checksum(identity, dimension, *own, matrix)]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            matrix = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dimension)
            for row in zip(*columns, matrix, strict=True):
                if held and (row[0] != held[0][0] or len(held) == BLOCK):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    return run


def _written(chunks: DataFrame, path: str, about: dict, buckets: int, mode: str) -> None:
    digest, dimension = embedding.identity_digest(about), int(about["dimension"])
    sound = vector.sound(chunks, dimension).select(bucket_of(F.col("page_id"), buckets).alias("bucket"), "page_id", "ordinal", "start", "end", "embedding")
    placed = sound.repartition(buckets, "bucket").sortWithinPartitions("bucket", "page_id", "ordinal")
    blocks = placed.mapInArrow(_blocks(digest, dimension), _BLOCK)
    blocks.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(f"{path}/blocks")


def write(chunks: DataFrame, path: str, about: dict, buckets: int = BUCKETS) -> None:
    """Stores chunks (page_id, ordinal, start, end, embedding); about is the provider's identity."""
    spark = chunks.sparkSession
    _written(chunks, path, about, buckets, "static")
    stored = _all_blocks(spark, path).agg(F.coalesce(F.sum(F.size("pages")), F.lit(0)).cast("long").alias("n")).first()["n"]
    manifest = spark.createDataFrame([(VERSION, embedding.identity_digest(about), int(about["dimension"]), buckets, stored)], _MANIFEST)
    manifest.coalesce(1).write.parquet(f"{path}/manifest")  # last, so a store without it is no store


def _all_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCK).option("basePath", f"{path}/blocks").parquet(f"{path}/blocks")


def manifest(spark: SparkSession, path: str, about: dict):
    """The store's manifest row, or None where there is no store of this identity, dimension and version."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    row = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").first()
    same = row is not None and (row["version"], row["identity"], row["dimension"]) == (VERSION, embedding.identity_digest(about), int(about["dimension"]))
    return row if same else None


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One block at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _holds(block: dict, digest: str, dimension: int) -> bool:
    n = len(block["pages"] or [])
    sized = block["dimension"] == dimension and len(block["matrix"] or b"") == 4 * n * dimension and all(len(block[c] or []) == n for c in ("ordinals", "starts", "ends"))
    return sized and block["identity"] == digest and _checksum(digest, dimension, block["pages"], block["ordinals"], block["starts"], block["ends"], block["matrix"]) == block["checksum"]


def bad_blocks(spark: SparkSession, path: str, about: dict) -> DataFrame:
    """(bucket, vectors) of the blocks whose identity, shape or checksum does not hold."""
    digest, dimension = embedding.identity_digest(about), int(about["dimension"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each(batches):
            if not _holds(b, digest, dimension):
                yield pa.record_batch([pa.array([b["bucket"]], pa.int32()), pa.array([len(b["pages"] or [])], pa.int32())], names=["bucket", "vectors"])

    return _all_blocks(spark, path).mapInArrow(run, "bucket int, vectors int")


def repaired(spark: SparkSession, path: str, chunks: DataFrame, about: dict, make: Callable = embedding.HashedProjection) -> int:
    """Embeds the chunks (page_id, ordinal, start, end, chunk) of buckets with bad blocks again and writes those
    buckets anew. The number of buckets."""
    buckets = manifest(spark, path, about)["buckets"]
    bad = [r["bucket"] for r in bad_blocks(spark, path, about).select("bucket").distinct().collect()]
    if bad:
        own = chunks.where(bucket_of(F.col("page_id"), buckets).isin(bad))
        _written(embedding.embedded(own, "chunk", make), path, about, buckets, "dynamic")
    return len(bad)


def _near(blocks: DataFrame, candidates: DataFrame | None, buckets: int) -> DataFrame:
    """The blocks of buckets that hold a candidate: a filter on the folders, so that the others' files are not listed.
    The driver sees at most a number a bucket."""
    if candidates is None:
        return blocks
    wanted = [r["bucket"] for r in candidates.select(bucket_of(F.col("page_id"), buckets).alias("bucket")).distinct().collect()]
    return blocks.where(F.col("bucket").isin(wanted))


def gathered(spark: SparkSession, path: str, about: dict, candidates: DataFrame | None = None) -> DataFrame:
    """(page_id, ordinal, start, end, embedding) of the candidates' (page_id) chunks, or of all."""
    held = manifest(spark, path, about)
    if held is None:
        raise FileNotFoundError(f"no vectors of this identity under {path}")
    digest, dimension = held["identity"], held["dimension"]
    few = None
    if candidates is not None:
        candidates = cut(candidates.select("page_id").distinct(), "candidates")
        if candidates.count() <= lexical.SENT:
            few = frozenset(r["page_id"] for r in candidates.collect())  # go to the blocks, whose vectors stay where they are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each(batches):
            if _holds(b, digest, dimension):
                flat = pa.array(np.frombuffer(b["matrix"], dtype="<f4"))
                vectors = pa.FixedSizeListArray.from_arrays(flat, dimension).cast(pa.list_(pa.float32()))
                rows = pa.record_batch([pa.array(b["pages"], pa.string()), *(pa.array(b[c], pa.int32()) for c in ("ordinals", "starts", "ends")), vectors], names=["page_id", "ordinal", "start", "end", "embedding"])
                yield rows if few is None else rows.filter(pa.array([p in few for p in b["pages"]], pa.bool_()))

    rows = _near(_all_blocks(spark, path), candidates, held["buckets"]).mapInArrow(run, "page_id string, ordinal int, start int, end int, embedding array<float>")
    return rows if candidates is None or few is not None else rows.join(candidates, "page_id", "left_semi")


def _scorer(asked, digest: str, dimension: int, most: int) -> Callable:
    """Of each block the pages that are among a query's first ``most`` of the block, ties included, by best chunk."""
    ids, matrix = asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each(batches):
            if not _holds(b, digest, dimension):
                continue
            own = np.frombuffer(b["matrix"], dtype="<f4").reshape(-1, dimension).astype(np.float64)
            scores = own @ matrix.T / np.sqrt(np.einsum("ij,ij->i", own, own))[:, None]
            # rows are sorted by page and ordinal, so the first greatest of a page has its lowest ordinal
            first = [k for k, p in enumerate(b["pages"]) if not k or p != b["pages"][k - 1]]
            best = np.maximum.reduceat(scores, first, axis=0)
            page = np.repeat(np.arange(len(first)), np.diff([*first, len(own)]))
            least = np.sort(best, axis=0)[-most] if len(first) > most else np.full(best.shape[1], -np.inf)
            out = []
            for r, q in zip(*np.nonzero(best >= least), strict=True):
                k = first[r] + int(np.argmax(scores[page == r, q]))
                out.append((ids[q], b["pages"][k], b["ordinals"][k], b["starts"][k], b["ends"][k], float(best[r, q])))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "page_id", "ordinal", "start", "end", "score"])

    return run


def search(spark: SparkSession, path: str, about: dict, queries: DataFrame, pages: DataFrame, limit: int = 8, within: DataFrame | None = None) -> DataFrame:
    """(query_id, page_id, path, role, score, rank, ordinal, start, end): the first pages of each query (query_id,
    vector) by their best chunk, among all stored pages or those within (page_id). The queries are the query set: they
    go to every task."""
    held = manifest(spark, path, about)
    if held is None:
        raise FileNotFoundError(f"no vectors of this identity under {path}")
    if within is not None:
        scored = vector.scores(gathered(spark, path, about, within), queries)
        return _placed(scored, pages, limit)
    rows = vector.sound(queries.withColumnRenamed("vector", "embedding"), held["dimension"]).select("query_id", "embedding").collect()
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(len(rows), held["dimension"])
    asked = [r["query_id"] for r in rows], matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    found = _all_blocks(spark, path).mapInArrow(_scorer(asked, held["identity"], held["dimension"], limit), "query_id long, page_id string, ordinal int, start int, end int, score double")
    return _placed(found, pages, limit)


def _placed(scored: DataFrame, pages: DataFrame, limit: int) -> DataFrame:
    best = scored.groupBy("query_id", "page_id").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("o"), "start", "end")).alias("b"))
    flat = best.select("query_id", "page_id", "b.score", (-F.col("b.o")).alias("ordinal"), "b.start", "b.end")
    return vector.top_pages(flat, pages, limit, "ordinal", "start", "end")


def answered(found: DataFrame, queries: DataFrame, pages: DataFrame, limit: int = 8) -> DataFrame:
    """found, and the overview for blank queries (query_id, query); other queries that find nothing find nothing."""
    silent = queries.where(F.trim(F.coalesce("query", F.lit(""))) == "").select("query_id")
    head = lexical.overview(pages, limit)
    return found.select(*lexical.RESULT).union(silent.join(F.broadcast(head)).select(*lexical.RESULT))
